"""Sources: datasets of pixels or features, and literal ones.

Rasters are pixel rows t_start, t_end, band, y, x, value, one for each pixel of the grid; NULL is no data.  Vectors are rows
t_start, t_end, geom (unless the kind is Data) and columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.engine.graph import Context, GraphError, Operator
from terrafold.functions import geometry
from terrafold.model.descriptor import PIXEL_TYPES, RasterDescriptor, VectorDescriptor
from terrafold.model.rect import Rect
from terrafold.model.time import MAX_MS, MIN_MS, TimeStep, interval_intersects

RESERVED = ("t_start", "t_end", "geom")
COLUMN_TYPES = {"category": "smallint", "int": "bigint", "float": "double", "text": "string", "bool": "boolean", "datetime": "timestamp"}


def identity(columns: list[str]) -> Column:
    """A key of a feature from its content, the same whenever the row is computed again; equal features share it."""
    own = [F.col(f"`{c}`") for c in columns]
    own += [c.isNull() for c in own]  # a hash passes over NULLs
    return F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit("b"), *own).alias("b"))


def within(df: DataFrame, desc: VectorDescriptor, rect: Rect) -> DataFrame:
    """Features that meet the box and the time of a query, with the columns that it asks for."""
    df = rect.in_time(df)
    if rect.bbox is not None and desc.geometry != "Data":
        df = df.where(geometry.overlaps_box(F.col("geom"), desc.geometry, rect.bbox))
    if rect.columns is not None:
        df = df.select(*[c for c in df.columns if c in RESERVED or c in rect.columns])
    return df


ALWAYS = (MIN_MS, MAX_MS)
#: Parameter: pixels of a slice that one task makes at most.
TASK_PIXELS = 4_000_000


def fill_gaps(slices: list[tuple[int, int]], time: tuple[int, int], step: TimeStep | None, reference: int) -> list[tuple[int, int]]:
    """Slices without data that, with ``slices``, cover ``time``: one for each step, or one for each gap if there is no step."""
    own = sorted(s for s in set(slices) if interval_intersects(s, time))
    if step is not None:
        covered = {i for a, b in own for i in range(step.index_ms(max(a, time[0]), reference), step.index_ms(max(max(a, time[0]), min(b, time[1]) - 1), reference) + 1)}
        return [s for s in step.steps(*time, reference) if step.index_ms(s[0], reference) not in covered]
    edges = [time[0], *[e for s in own for e in s], time[1]]
    gaps = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
    return gaps if own else [time]


def missing_slices(spark: SparkSession, slices: DataFrame, time: tuple[int, int], step: TimeStep | None, reference: int) -> DataFrame:
    """``fill_gaps`` as a lazy table: slices (t_start, t_end) may be any number, and no job runs here."""
    t0, t1 = time
    start, end = F.greatest("t_start", F.lit(t0)), F.least("t_end", F.lit(t1))
    if step is not None:
        first, last = step.index_ms(t0, reference), step.index_ms(max(t0, t1 - 1), reference)
        every = spark.range(first, last + 1).select(F.col("id").alias("i"))
        seen = slices.select(F.explode(F.sequence(step.index(start, reference), step.index(F.greatest(start, end - 1), reference))).alias("i")).distinct()
        return every.join(seen, "i", "left_anti").select(step.at(F.col("i"), reference).alias("t_start"), step.at(F.col("i") + 1, reference).alias("t_end"))
    if t0 == t1:
        return slices.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(t0).alias("t_start"), F.lit(t1).alias("t_end"))
    ends = spark.createDataFrame([(t0, t0), (t1, t1)], "t_start long, t_end long")
    before = Window.orderBy("t_start", "t_end").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are time steps
    gaps = slices.select(start.alias("t_start"), end.alias("t_end")).unionByName(ends).select(F.max("t_end").over(before).alias("a"), F.col("t_start").alias("b"))
    return gaps.where("a < b").select(F.col("a").alias("t_start"), F.col("b").alias("t_end"))


def dense(ctx: Context, slices: DataFrame, pixels: tuple[int, int, int, int], bands: int) -> DataFrame:
    """Pixel rows without value for each of ``slices`` (t_start, t_end)."""
    a, b, c, d = pixels
    step = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high)))
    lines = slices.select("t_start", "t_end", step(0, bands - 1).alias("band")).select("*", step(a, b).alias("y"))
    if bands * (b - a + 1) * (d - c + 1) > TASK_PIXELS:  # so that not one task makes a whole slice
        lines = lines.repartition("t_start", "band", "y")
    return lines.select("*", step(c, d).alias("x"))


def empty_pixels(ctx: Context, slices: DataFrame, desc: RasterDescriptor, rect: Rect) -> DataFrame:
    """``dense`` rows of a descriptor's grid inside ``rect``, with value."""
    made = dense(ctx, slices, rect.pixels or desc.pixels, len(desc.bands))
    return Rect(bands=rect.bands).of_pixels(made).withColumn("value", F.lit(None).cast(PIXEL_TYPES[desc.data_type][2]))


def overview(df: DataFrame, n: int) -> DataFrame:
    """Every n-th pixel along both axes."""
    return df.where((F.pmod("y", F.lit(n)) == 0) & (F.pmod("x", F.lit(n)) == 0)).withColumns({"y": (F.col("y") / n).cast("int"), "x": (F.col("x") / n).cast("int")}) if n > 1 else df


def overview_descriptor(desc: RasterDescriptor, n: int) -> RasterDescriptor:
    t, (a, b, c, d) = desc.transform, desc.pixels
    return desc.but(transform=type(t)(t.x, t.y, t.x_size * n, t.y_size * n), pixels=(-(-a // n), b // n, -(-c // n), d // n)) if n > 1 else desc


@dataclass(frozen=True)
class GdalSource(Operator):
    """One raster dataset.  ``overviewLevel`` L reads every L-th pixel.

    Gaps in the time of a query become slices without data: one for each step of a regular dataset, one for each gap of another.  Which
    slices there are is told by the dataset's loading information, else by the times of its pixels.  ``fillGaps`` false leaves gaps out.
    """

    TYPE: ClassVar[str] = "GdalSource"
    data: str = ""
    overview_level: int | None = None
    fill_gaps: bool = True

    def describe(self, ctx: Context) -> RasterDescriptor:
        desc = ctx.descriptor(self.data)
        if desc.kind != "raster":
            raise GraphError(f"{self.data} is no raster")
        return overview_descriptor(desc, self.overview_level or 1)

    @staticmethod
    def _time(desc: RasterDescriptor, rect: Rect) -> tuple[int, int] | None:
        """The time that must be covered; None if nothing bounds it."""
        return rect.time if rect.time != ALWAYS else desc.time

    def times(self, ctx: Context, rect: Rect) -> list[tuple[int, int]] | None:
        known, desc = ctx.known_slices(self.data), self.describe(ctx)
        if known is None:
            return None
        own, time = [s for s in known if rect.time == ALWAYS or interval_intersects(s, rect.time)], self._time(desc, rect)
        return sorted({*own, *fill_gaps(known, time, desc.step, desc.reference)}) if self.fill_gaps and time else own

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        df, own = ctx.dataset(self.data)[0], self.describe(ctx)
        rect = rect.on_grid(own.transform)
        found = rect.of_pixels(overview(df.select("t_start", "t_end", "band", "y", "x", "value"), self.overview_level or 1))
        time, known = self._time(own, rect), ctx.known_slices(self.data)
        if not self.fill_gaps or time is None:
            return found
        if known is not None:
            gaps = fill_gaps(known, time, own.step, own.reference)
            if not gaps:
                return found
            missing = ctx.spark.createDataFrame(gaps, "t_start long, t_end long")
        else:
            missing = missing_slices(ctx.spark, rect.but(time=time).in_time(df.select("t_start", "t_end")).distinct(), time, own.step, own.reference)
        return found.unionByName(empty_pixels(ctx, missing, own, rect))


@dataclass(frozen=True)
class MultiBandGdalSource(Operator):
    """Many files for a time and band, mosaicked by ``z_index``: of the pixels with data the one of the last file counts.

    Every pixel of the grid has a row in each time step, also where no file covers it.  Time steps are those of the loading information, also ones
    without files, else the times of the files.  ``overviewLevel`` as for GdalSource.
    """

    TYPE: ClassVar[str] = "MultiBandGdalSource"
    data: str = ""
    overview_level: int | None = None

    def describe(self, ctx: Context) -> RasterDescriptor:
        return overview_descriptor(ctx.descriptor(self.data), self.overview_level or 1)

    def times(self, ctx: Context, rect: Rect) -> list[tuple[int, int]] | None:
        known = ctx.known_slices(self.data)
        return None if known is None else [s for s in known if rect.time == ALWAYS or interval_intersects(s, rect.time)]

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        df, own = ctx.dataset(self.data)[0], self.describe(ctx)
        rect = rect.on_grid(own.transform)
        found = rect.of_pixels(overview(df, self.overview_level or 1))
        steps = self.times(ctx, rect)
        slices = rect.in_time(df.select("t_start", "t_end")).distinct() if steps is None else ctx.spark.createDataFrame(steps, "t_start long, t_end long")
        # pixels without a file are rows of no file: one aggregation, and no join with the grid
        every = found.select("t_start", "t_end", "band", "y", "x", "value", "z_index").unionByName(empty_pixels(ctx, slices, own, rect).withColumn("z_index", F.lit(None).cast(found.schema["z_index"].dataType)))
        value = F.max_by("value", F.when(F.col("value").isNotNull(), F.col("z_index")))
        return every.groupBy("t_start", "t_end", "band", "y", "x").agg(value.alias("value"))


def parsed_time(column: Column, form: str, custom: str | None = None) -> Column:
    """Epoch milliseconds from a custom pattern, unix seconds, unix milliseconds or ISO 8601 (``auto``); a date is its midnight UTC."""
    if form == "seconds":
        return F.floor(column.cast("double") * 1000).cast("long")
    if form == "milliseconds":
        return column.cast("long")
    when = F.to_timestamp(column.cast("string"), custom) if form == "custom" else F.to_timestamp(column.cast("string"))
    return F.unix_millis(when)


@dataclass(frozen=True)
class OgrSource(Operator):
    """A vector dataset of named columns.

    attribute_projection: columns to keep.  attribute_filters: dicts of attribute, ranges (inclusive), keepNulls.
    time: a dict: kind none, start, startEnd or startDuration; start, end or duration (a field, or milliseconds, "infinite", "zero"); format.
    attribute_query: a condition in SQL on the dataset's own columns.
    columns: dict of x, y (points) or geometry (a dict of name and type: a column that holds geometries), int, float, text, bool, datetime (lists),
    rename (a dict).  on_error: ignore drops rows whose values or geometry can't be read, abort raises.
    """

    TYPE: ClassVar[str] = "OgrSource"
    data: str = ""
    attribute_projection: tuple[str, ...] | None = None
    attribute_filters: tuple = ()
    time: dict = field(default_factory=lambda: {"kind": "none"}, hash=False)
    columns: dict = field(default_factory=dict, hash=False)
    on_error: str = "ignore"
    attribute_query: str | None = None

    def _types(self) -> dict[str, str]:
        rename = self.columns.get("rename", {})
        return {rename.get(c, c): kind for kind in ("int", "float", "text", "bool", "datetime") for c in self.columns.get(kind, ())}

    def describe(self, ctx: Context) -> VectorDescriptor:
        ctx.descriptor(self.data)
        types = self._types()
        if self.attribute_projection is not None:
            if unknown := set(self.attribute_projection) - set(types):
                raise GraphError(f"unknown columns {sorted(unknown)}")
            types = {c: types[c] for c in self.attribute_projection}
        shape = self.columns.get("geometry", {}).get("type") or ("MultiPoint" if "x" in self.columns else "Data")
        if shape != "Data" and shape not in geometry.GEOMETRY_TYPES:
            raise GraphError(f"unknown kind of geometry {shape!r}")
        return VectorDescriptor(shape, types)

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        from terrafold.operators.vector import range_predicate

        df, _ = ctx.dataset(self.data)
        if self.attribute_query:
            df = df.where(F.expr(self.attribute_query))
        strict = self.on_error == "abort"
        cast = (lambda c, t: c.cast(t)) if strict else (lambda c, t: c.try_cast(t))
        rename, out, bad = self.columns.get("rename", {}), {}, F.lit(False)
        for kind in ("int", "float", "text", "bool", "datetime"):
            for c in self.columns.get(kind, ()):
                out[rename.get(c, c)] = cast(F.col(c), COLUMN_TYPES[kind])
                bad = bad | (F.col(c).isNotNull() & out[rename.get(c, c)].isNull())
        spec = self.time
        read = lambda key: parsed_time(F.col(spec[key]), spec.get("format", "auto"), spec.get("custom"))
        start, end = F.lit(MIN_MS), F.lit(MAX_MS)
        if spec["kind"] != "none":
            start = F.coalesce(read("start"), F.lit(MIN_MS))
            if spec["kind"] == "startEnd":
                end = F.coalesce(read("end"), F.lit(MAX_MS))
            elif spec["kind"] == "startDuration":  # a field of milliseconds
                end = start + F.col(spec["duration"]).cast("long")
            else:
                duration = spec.get("duration", "zero")
                end = F.lit(MAX_MS) if duration == "infinite" else start if duration == "zero" else start + F.lit(int(duration))
            end = F.when(F.col(spec["start"]).isNull(), F.lit(MAX_MS)).otherwise(end)
        chosen = [start.cast("long").alias("t_start"), end.cast("long").alias("t_end")]
        if "x" in self.columns:
            x, y = (cast(F.col(self.columns[k]), "double") for k in "xy")
            bad = bad | x.isNull() | y.isNull()
            chosen.append(geometry.multi_point(x, y).alias("geom"))
        elif "geometry" in self.columns:
            shape = F.col(self.columns["geometry"].get("name", "geom"))
            bad = bad | shape.isNull()
            chosen.append((F.coalesce(shape, F.raise_error(F.lit("a feature has no geometry of this kind"))) if strict else shape).alias("geom"))
        if not strict:
            df = df.where(~bad)
        df = df.select(*chosen, *[v.alias(k) for k, v in out.items()])
        for f in self.attribute_filters:
            df = df.where(range_predicate(F.col(f["attribute"]), f["ranges"], f.get("keepNulls", False)))
        if self.attribute_projection is not None:
            df = df.select(*[c for c in df.columns if c in RESERVED or c in self.attribute_projection])
        return within(df, self.describe(ctx), rect)


@dataclass(frozen=True)
class CsvSource(Operator):
    """Points of a CSV file with a header; only the coordinates are read, and time is always."""

    TYPE: ClassVar[str] = "CsvSource"
    file_path: str = ""
    field_separator: str = ","
    geometry: dict = field(default_factory=lambda: {"type": "xy", "x": "x", "y": "y"}, hash=False)
    time: str = "None"

    def describe(self, ctx: Context) -> VectorDescriptor:
        if len(self.field_separator) != 1:
            raise GraphError("a separator is one character")
        return VectorDescriptor("MultiPoint")

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        df = ctx.spark.read.csv(self.file_path, header=True, sep=self.field_separator)
        x, y = (F.col(self.geometry[k]).cast("double") for k in "xy")
        df = df.select(F.lit(MIN_MS).alias("t_start"), F.lit(MAX_MS).alias("t_end"), x.alias("x"), y.alias("y"))
        if rect.bbox is not None:  # on plain columns, so that the reader can skip rows
            df = df.where(F.col("x").between(rect.bbox[0], rect.bbox[2]) & F.col("y").between(rect.bbox[1], rect.bbox[3]))
        return rect.in_time(df.select("t_start", "t_end", geometry.multi_point(F.col("x"), F.col("y")).alias("geom")))


@dataclass(frozen=True)
class MockPointSource(Operator):
    """Literal points."""

    TYPE: ClassVar[str] = "MockPointSource"
    points: tuple = ()

    def describe(self, ctx: Context) -> VectorDescriptor:
        return VectorDescriptor("MultiPoint")

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        rows = [(float(p["x"]), float(p["y"])) if isinstance(p, dict) else (float(p[0]), float(p[1])) for p in self.points]
        df = ctx.spark.createDataFrame(rows, "x double, y double")
        df = df.select(F.lit(MIN_MS).alias("t_start"), F.lit(MAX_MS).alias("t_end"), geometry.multi_point(F.col("x"), F.col("y")).alias("geom"))
        return within(df, self.describe(ctx), rect)


@dataclass(frozen=True)
class VectorSource(Operator):
    """A vector dataset as it is, by name."""

    TYPE: ClassVar[str] = "MockDatasetDataSource"
    data: str = ""

    def describe(self, ctx: Context) -> VectorDescriptor:
        desc = ctx.descriptor(self.data)
        if desc.kind != "vector":
            raise GraphError(f"{self.data} is no vector dataset")
        return desc

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        df, desc = ctx.dataset(self.data)
        own = ["t_start", "t_end", *(["geom"] if desc.geometry != "Data" else []), *desc.columns]
        return within(df.select(*own), desc, rect)


@dataclass(frozen=True)
class MockFeatureCollectionSource(Operator):
    """Literal features: rows (t_start, t_end, geom, column values...) of one kind of geometry."""

    TYPE: ClassVar[str] = "MockFeatureCollectionSource"
    geometry_type: str = "MultiPoint"
    columns: dict = field(default_factory=dict, hash=False)
    rows: tuple = ()

    def describe(self, ctx: Context) -> VectorDescriptor:
        return VectorDescriptor(self.geometry_type, dict(self.columns))

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        parts = ["t_start long", "t_end long"]
        if self.geometry_type != "Data":
            parts.append(f"geom {geometry.GEOMETRY_TYPES[self.geometry_type]}")
        parts += [f"`{c}` {COLUMN_TYPES[t]}" for c, t in self.columns.items()]
        return within(ctx.spark.createDataFrame([_lists(r) for r in self.rows], ", ".join(parts)), self.describe(ctx), rect)


def _lists(row: tuple) -> list:
    """Nested tuples of coordinates as lists of points."""
    def deep(v: Any) -> Any:
        if isinstance(v, (list, tuple)) and v and isinstance(v[0], (int, float)):
            return (float(v[0]), float(v[1]))
        return [deep(x) for x in v] if isinstance(v, (list, tuple)) else v

    return [deep(v) if isinstance(v, (list, tuple)) else v for v in row]


@dataclass(frozen=True)
class MockRasterSource(Operator):
    """Literal tiles: dicts of time (start, end), band, y, x (of the first pixel) and data (rows of values, None is no data)."""

    TYPE: ClassVar[str] = "MockRasterSource"
    tiles: tuple = field(default=(), hash=False)
    descriptor: RasterDescriptor | None = field(default=None, metadata={"json": False})

    def describe(self, ctx: Context) -> RasterDescriptor:
        if self.descriptor is None:
            raise GraphError("literal tiles need a descriptor")
        return self.descriptor

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        rows = [(*t["time"], t.get("band", 0), t.get("y", 0) + i, t.get("x", 0) + j, v) for t in self.tiles for i, row in enumerate(t["data"]) for j, v in enumerate(row)]
        kind = PIXEL_TYPES[self.descriptor.data_type][2]
        wide, cast = ("double", float) if kind in ("float", "double") else ("long", int)
        rows = [(*r[:-1], None if r[-1] is None else cast(r[-1])) for r in rows]
        df = ctx.spark.createDataFrame(rows, f"t_start long, t_end long, band int, y int, x int, value {wide}")
        return rect.on_grid(self.descriptor.transform).of_pixels(df.withColumn("value", F.col("value").cast(kind)))
