"""Results as GeoJSON, PNG, Arrow and stored datasets."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.engine.workers import importable
from terrafold.model.descriptor import RasterDescriptor
from terrafold.model.time import MAX_MS, MIN_MS


def geojson(df: DataFrame, geometry: str) -> DataFrame:
    """One column ``feature``: a GeoJSON Feature for each row, with its interval under ``when``."""
    points = lambda a: F.transform(a, lambda p: F.array(p["x"], p["y"]))
    coordinates = {
        "MultiPoint": lambda g: points(g),
        "MultiLineString": lambda g: F.transform(g, points),
        "MultiPolygon": lambda g: F.transform(g, lambda p: F.transform(p, points)),
    }.get(geometry)
    shape = F.struct(F.lit(geometry).alias("type"), coordinates(F.col("geom")).alias("coordinates")) if coordinates else F.lit(None).cast("string")
    # years beyond 9999 have no timestamp in Spark; the first and last instant are spelled out
    text = lambda c: F.when(c <= MIN_MS, iso_bound(MIN_MS)).when(c >= MAX_MS, iso_bound(MAX_MS)).otherwise(F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    when = F.struct(text(F.col("t_start")).alias("start"), text(F.col("t_end")).alias("end"), F.lit("Interval").alias("type"))
    own = [c for c in df.columns if c not in ("t_start", "t_end", "geom")]
    properties = F.struct(*own) if own else F.create_map().cast("map<string,string>")
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), properties.alias("properties"), when.alias("when")), {"ignoreNullFields": "false"}).alias("feature"))


def iso_bound(ms: int) -> str:
    return "-262143-01-01T00:00:00+00:00" if ms == MIN_MS else "+262142-12-31T23:59:59.999+00:00"


def feature_collection(df: DataFrame, geometry: str) -> str:
    """The whole document, on the driver: for results as small as a map's."""
    return '{"type":"FeatureCollection","features":[' + ",".join(r[0] for r in geojson(df, geometry).toLocalIterator()) + "]}"


@dataclass(frozen=True)
class Colorizer:
    """kind: linear or logarithmic gradient between breakpoints (value, RGBA), or palette of exact values."""

    kind: str
    points: tuple[tuple[float, tuple[int, int, int, int]], ...]
    no_data: tuple[int, int, int, int] = (0, 0, 0, 0)
    under: tuple[int, int, int, int] | None = None
    over: tuple[int, int, int, int] | None = None

    def columns(self, value: Column) -> list[Column]:
        """Red, green, blue and alpha."""
        v = value.cast("double")
        at = (lambda c: F.log10(c)) if self.kind == "logarithmic" else (lambda c: c)
        out = []
        for k in range(4):
            c = F.when(v.isNull() | F.isnan(v), self.no_data[k])
            if self.kind == "palette":
                for x, rgba in self.points:
                    c = c.when(v == x, rgba[k])
                out.append(c.otherwise((self.over or self.no_data)[k]))
                continue
            c = c.when(v < self.points[0][0], (self.under or self.points[0][1])[k])
            for (x0, a), (x1, b) in zip(self.points, self.points[1:], strict=False):
                share = (at(v) - at(F.lit(x0))) / (at(F.lit(x1)) - at(F.lit(x0)))
                c = c.when(v <= x1, F.floor(a[k] + share * (b[k] - a[k]) + 0.5).cast("int"))
            out.append(c.otherwise((self.over or self.points[-1][1])[k]))
        return out


def colored(df: DataFrame, colorizer: Colorizer) -> DataFrame:
    """y, x, r, g, b, a of each pixel, computed on the executors."""
    return df.select("y", "x", *[c.cast("int").alias(n) for c, n in zip(colorizer.columns(F.col("value")), "rgba", strict=True)])


def png(df: DataFrame, colorizer: Colorizer, pixels: tuple[int, int, int, int]) -> bytes:
    """A PNG of the pixels of one slice and band."""
    return encoded_png(colored(df, colorizer), pixels, colorizer.no_data)


def rgb(df: DataFrame, low: float, high: float) -> DataFrame:
    """y, x, r, g, b, a of bands 0 to 2 as red, green and blue, from ``low`` (dark) to ``high``; clear where any has no data."""
    share = lambda k: F.max(F.when(F.col("band") == k, F.col("value"))).cast("double")
    wide = df.where("band < 3").groupBy("y", "x").agg(*[share(k).alias(f"v{k}") for k in range(3)])
    byte = lambda k: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col(f"v{k}") - low) / (high - low) * 255 + 0.5)))
    known = F.col("v0").isNotNull() & F.col("v1").isNotNull() & F.col("v2").isNotNull()
    return wide.select("y", "x", *[F.when(known, byte(k)).otherwise(0).cast("int").alias(n) for k, n in enumerate("rgb")], F.when(known, 255).otherwise(0).cast("int").alias("a"))


def rgb_png(df: DataFrame, pixels: tuple[int, int, int, int], low: float, high: float) -> bytes:
    """A PNG of three bands of one slice."""
    return encoded_png(rgb(df, low, high), pixels, (0, 0, 0, 0))


def encoded_png(colors: DataFrame, pixels: tuple[int, int, int, int], empty: tuple[int, int, int, int]) -> bytes:
    """A PNG of y, x, r, g, b, a."""
    a, b, c, d = pixels
    height, width = b - a + 1, d - c + 1
    image = bytearray(bytes(empty) * (height * width))
    for y, x, *rgba in colors.toLocalIterator():
        at = ((y - a) * width + x - c) * 4
        image[at : at + 4] = bytes(rgba)
    raw = b"".join(b"\0" + image[i * width * 4 : (i + 1) * width * 4] for i in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tiles(df: DataFrame, size: int = 512) -> DataFrame:
    """Pixel rows as tiles: t_start, t_end, band, tile_y, tile_x, data (row by row; NULL is no data)."""
    place = F.pmod("y", F.lit(size)) * size + F.pmod("x", F.lit(size))
    own = df.groupBy("t_start", "t_end", "band", F.floor(F.col("y") / size).alias("tile_y"), F.floor(F.col("x") / size).alias("tile_x"))
    # structs keep pixels without data, which a list of values would leave out; a tile has size * size of them at most
    return own.agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("i"), "value"))), lambda s: s["value"]).alias("data"))


def arrow(df: DataFrame) -> Any:
    """An Arrow table, for clients."""
    return df.toArrow()


def store(df: DataFrame, descriptor: Any, path: str) -> None:
    """A dataset: Parquet, rasters in order of time and place so that scans can skip, and the descriptor as JSON beside it."""
    if isinstance(descriptor, RasterDescriptor):
        df = df.repartitionByRange("t_start", "y").sortWithinPartitions("t_start", "band", "y", "x")
    df.write.parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(json.dumps(asdict(descriptor), default=str),)], "value string").coalesce(1).write.text(f"{path}/descriptor")


#: Numbers of the sample formats and of the types of TIFF.
_SAMPLE = {"U8": (1, "B"), "U16": (1, "H"), "U32": (1, "I"), "I8": (2, "b"), "I16": (2, "h"), "I32": (2, "i"), "F32": (3, "f"), "F64": (3, "d")}


def geotiff(df: DataFrame, descriptor: RasterDescriptor, pixels: tuple[int, int, int, int], no_data: float) -> bytes:
    """An uncompressed GeoTIFF of one slice; each band is a plane.  For results as small as a map; ``geotiffs`` takes larger ones."""
    rows = df.where("value is not null").select("band", "y", "x", "value").toLocalIterator()
    return encoded_geotiff(rows, descriptor, pixels, no_data)


def geotiffs(df: DataFrame, descriptor: RasterDescriptor, pixels: tuple[int, int, int, int], no_data: float, size: int = 4096) -> DataFrame:
    """t_start, t_end, y, x, content: a GeoTIFF for each slice and each square of ``size`` pixels, made on the executors.

    y and x are the first row and column of a file.  A file holds at most size * size pixels of each band, whatever the grid's size.
    """
    importable(df.sparkSession)
    a, b, c, d = pixels
    place = lambda v, low: (F.floor((F.col(v) - low) / size) * size + low).cast("int")
    own = df.where(F.col("y").between(a, b) & F.col("x").between(c, d)).groupBy("t_start", "t_end", place("y", a).alias("y0"), place("x", c).alias("x0"))

    def encode(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        start, end, y0, x0 = (int(v) for v in key)
        known = part[part["value"].notna()]
        rows = zip(known["band"], known["y"], known["x"], known["value"], strict=True)
        made = encoded_geotiff(rows, descriptor, (y0, min(b, y0 + size - 1), x0, min(d, x0 + size - 1)), no_data)
        return pd.DataFrame({"t_start": [start], "t_end": [end], "y": [y0], "x": [x0], "content": [made]})

    return own.applyInPandas(encode, "t_start long, t_end long, y int, x int, content binary")


def encoded_geotiff(rows: Iterable[tuple], descriptor: RasterDescriptor, pixels: tuple[int, int, int, int], no_data: float) -> bytes:
    """The bytes of a file of pixels (band, y, x, value)."""
    a, b, c, d = pixels
    height, width, bands = b - a + 1, d - c + 1, len(descriptor.bands)
    kind, code = _SAMPLE[descriptor.data_type]
    planes = [[no_data] * (height * width) for _ in range(bands)]
    for band, y, x, value in rows:
        planes[band][(y - a) * width + x - c] = value
    size, t = struct.calcsize(code), descriptor.transform
    body = b"".join(struct.pack(f"<{height * width}{code}", *(int(v) if kind < 3 else float(v) for v in p)) for p in planes)
    epsg = int(descriptor.srs.rpartition(":")[2])
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if epsg == 4326 else 1, 1025, 0, 1, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg]
    text = f"{no_data:g}".encode() + b"\0"
    plane = height * width * size
    tags = [
        (256, "I", [width]), (257, "I", [height]), (258, "H", [8 * size] * bands), (259, "H", [1]), (262, "H", [1]), (273, "I", [8 + k * plane for k in range(bands)]), (277, "H", [bands]), (278, "I", [height]), (279, "I", [plane] * bands), (284, "H", [2]),
        (339, "H", [kind] * bands), (33550, "d", [abs(t.x_size), abs(t.y_size), 0.0]), (33922, "d", [0.0, 0.0, 0.0, t.x + c * t.x_size, t.y + a * t.y_size, 0.0]), (34735, "H", keys), (42113, "s", [text]),
    ]
    numbers = {"H": 3, "I": 4, "d": 12, "s": 2}
    at = 8 + len(body) + (len(body) % 2)
    entries, extra = b"", b""
    start = at + 2 + 12 * len(tags) + 4
    for tag, form, values in tags:
        raw = values[0] if form == "s" else struct.pack(f"<{len(values)}{form}", *values)
        count = len(raw) if form == "s" else len(values)
        if len(raw) > 4:
            place = struct.pack("<I", start + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            place = raw.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, numbers[form], count) + place
    return b"II*\0" + struct.pack("<I", at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra
