"""Feature files as rows for OgrSource: GeoJSON and GeoPackage, read on the executors.

Both give ``geom`` (of one kind; single geometries become collections of one, heights are left out; NULL where a feature has none, or one of another
kind) and the named columns as text, which OgrSource casts and filters.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.engine.graph import GraphError
from terrafold.engine.workers import importable
from terrafold.functions.geometry import GEOMETRY_TYPES

#: Names of the kinds of geometry in WKB, by number, and how deep their coordinates are nested.
WKB_KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
DEPTH = {"Point": 0, "LineString": 1, "Polygon": 2, "MultiPoint": 1, "MultiLineString": 2, "MultiPolygon": 3}
#: Bytes of the bounds in the header of a GeoPackage's geometry, by their kind.
BOUNDS_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
#: Parameter: features that leave a GeoPackage at once.
FEATURES = 10_000


def known(kind: str) -> str:
    if kind not in GEOMETRY_TYPES:
        raise GraphError(f"unknown kind of geometry {kind!r}")
    return kind.removeprefix("Multi")


def _points(depth: int, c: Column) -> Column:
    """Nested arrays of numbers as nested arrays of points."""
    if depth == 0:
        return F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))
    return F.transform(c, lambda v: _points(depth - 1, v))


def read_geojson(spark: SparkSession, paths: list[str], kind: str, columns: tuple[str, ...] = (), lines: bool = False) -> DataFrame:
    """geom, ``columns``, when_start and when_end of each feature.

    A file is one document, a collection or a feature, and is read by one task; with ``lines`` each line is a feature, and files are split.
    """
    single = known(kind)
    feature = "geometry struct<type:string,coordinates:string>, properties map<string,string>, `when` struct<start:string,`end`:string>"
    schema = f"type string, {feature}, features array<struct<{feature.replace('geometry struct', 'geometry:struct').replace('properties map', 'properties:map').replace('`when` struct', '`when`:struct')}>>"
    text = spark.read.text(paths, wholetext=not lines).where(F.trim("value") != "")
    document = text.select(F.from_json(F.ltrim(F.col("value"), F.lit("\x1e\ufeff ")), schema).alias("d"))  # sequences mark a line by a separator
    own = F.array(F.struct("d.geometry", "d.properties", "d.when"))
    found = document.select(F.explode(F.when(F.col("d.type") == "FeatureCollection", F.col("d.features")).otherwise(own)).alias("f"))
    shape, depth = F.col("f.geometry"), DEPTH[kind]
    nested = lambda n: "array<" * (n + 1) + "double" + ">" * (n + 1)
    parsed = lambda n: _points(n, F.from_json(shape["coordinates"], nested(n)))
    geom = F.when(shape["type"] == kind, parsed(depth)).when(shape["type"] == single, F.array(parsed(depth - 1)))
    names = [F.col("f.properties")[c].alias(c) for c in columns]
    return found.select(geom.cast(GEOMETRY_TYPES[kind]).alias("geom"), *names, F.col("f.when.start").alias("when_start"), F.col("f.when.end").alias("when_end"))


def parse_wkb(raw: bytes, at: int = 0) -> tuple[str, list | tuple, int]:
    """(kind, nested points, end) of a geometry in well-known binary form, in either byte order and with heights or measures."""
    order = "<" if raw[at] else ">"
    code = struct.unpack_from(order + "I", raw, at + 1)[0]
    flags, code = code >> 29, code & 0x1FFFFFFF
    size = 2 + (flags >> 2) + (flags >> 1 & 1) + {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]  # marked by bits, or by thousands
    at += 9 if flags & 1 else 5
    kind = WKB_KINDS.get(code % 1000)
    if kind is None:
        raise GraphError(f"unknown kind of geometry {code}")

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", raw, at - 4)[0]

    def run(n: int) -> list[tuple[float, float]]:
        nonlocal at
        values = struct.unpack_from(f"{order}{n * size}d", raw, at)
        at += 8 * n * size
        return list(zip(values[::size], values[1::size], strict=True))

    if kind == "Point":
        return kind, run(1)[0], at
    if kind == "LineString":
        return kind, run(count()), at
    if kind == "Polygon":
        return kind, [run(count()) for _ in range(count())], at
    parts = []
    for _ in range(count()):
        _, part, at = parse_wkb(raw, at)
        parts.append(part)
    return kind, parts, at


def collected(raw: bytes | None, kind: str) -> list | None:
    """Nested arrays of points as Arrow takes them, None for no geometry or one of another kind."""
    if raw is None:
        return None
    found, points, _ = parse_wkb(raw)
    if found == kind.removeprefix("Multi"):
        points = [points]
    elif found != kind:
        return None
    deep = lambda v: {"x": v[0], "y": v[1]} if isinstance(v, tuple) else [deep(p) for p in v]
    own = deep(points)
    return [p for p in own if p["x"] == p["x"]] or None if kind == "MultiPoint" else own  # an empty point is not a number


def from_wkb(column: Column, kind: str) -> Column:
    """Geometry of a binary column in well-known binary form, as in GeoParquet."""
    known(kind)

    @F.pandas_udf(GEOMETRY_TYPES[kind])
    def read(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: collected(bytes(b) if b is not None else None, kind))

    return read(column)


def geopackage_wkb(blob: bytes | None) -> bytes | None:
    """The well-known binary form behind the header of a GeoPackage's geometry; None if it is empty."""
    if blob is None or blob[:2] != b"GP" or blob[3] & 0x10:
        return None
    return blob[8 + BOUNDS_BYTES[blob[3] >> 1 & 7] :]


def read_geopackage(spark: SparkSession, paths: list[str], layer: str, kind: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """geom and ``columns`` of each feature of a layer.  A file is read by one task, some thousand features at a time."""
    known(kind)
    importable(spark)
    quoted = lambda n: '"' + n.replace('"', '""') + '"'
    schema = ", ".join([f"geom {GEOMETRY_TYPES[kind]}", *(f"`{c.replace('`', '``')}` string" for c in columns)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                shape = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
                if shape is None:
                    raise GraphError(f"no layer {layer!r}")
                rows = db.execute(f"SELECT {', '.join(map(quoted, [shape[0], *columns]))} FROM {quoted(layer)}")
                while some := rows.fetchmany(FEATURES):
                    made = {"geom": [collected(geopackage_wkb(r[0]), kind) for r in some]}
                    made |= {c: [None if r[k] is None else str(r[k]) for r in some] for k, c in enumerate(columns, 1)}
                    yield pd.DataFrame(made)
                db.close()

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(run, schema)
