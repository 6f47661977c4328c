"""Plots: aggregations to a small table, and the document made of it.

``query`` gives the table as a DataFrame; ``document`` formats it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.engine.graph import Context, GraphError, Operator
from terrafold.model.descriptor import PlotDescriptor
from terrafold.model.rect import Rect
from terrafold.plots import vega


def finite(c: Column) -> Column:
    """A number, or NULL for what is none or infinite."""
    v = c.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


@dataclass(frozen=True)
class Plot(Operator):
    """Base: one source, or several."""

    def describe(self, ctx: Context) -> PlotDescriptor:
        for s in self.inputs():
            s.describe(ctx)
        self.check(ctx)
        return PlotDescriptor(getattr(self.inputs()[0].describe(ctx), "srs", None))

    def check(self, ctx: Context) -> None:
        """Raise if parameters are not valid."""

    def document(self, ctx: Context, rect: Rect) -> dict:
        raise NotImplementedError


def series(source: Operator, ctx: Context, rect: Rect, columns: tuple[str, ...] | None, name: str | None = None) -> list[tuple[str, DataFrame, Column]]:
    """(name, rows, value) of each column of a vector, or of the first band of a raster."""
    desc = source.describe(ctx)
    if desc.kind == "raster":
        if columns and name is None:
            raise GraphError("rasters have no columns")
        return [(name or desc.bands[0].name, source.query(ctx, rect.but(bands=(0,))), F.col("value"))]
    chosen = columns or tuple(c for c, t in desc.columns.items() if t in ("int", "float"))
    for c in chosen:
        if desc.columns.get(c) not in ("int", "float"):
            raise GraphError(f"column {c!r} is no number")
    df = source.query(ctx, rect.but(columns=tuple(chosen)))
    return [(c, df, F.col(c)) for c in chosen]


@dataclass(frozen=True)
class Statistics(Plot):
    """valueCount, validCount, min, max, mean, stddev (of a population, NaN below two values), percentiles.  NaN counts as no value.

    Percentiles are exact, interpolated between ranks, up to EXACT values; beyond, where exact ones would hold all distinct values of a
    column in one task, they come from a sketch whose ranks are off by at most a 100 000th.  All columns of a vector take one pass, after one that counts.
    """

    TYPE: ClassVar[str] = "Statistics"
    INPUTS: ClassVar[tuple[str, ...]] = ("source",)
    source: Operator | tuple[Operator, ...]
    column_names: tuple[str, ...] = ()
    percentiles: tuple[float, ...] = ()
    EXACT: ClassVar[int] = 5_000_000

    def _measures(self, v: Column, exact: bool) -> dict[str, Column]:
        v = F.when(~F.isnan(v.cast("double")), v.cast("double"))
        n = F.count(v)
        nan = F.lit(float("nan"))
        out = {
            "valueCount": F.count(F.lit(1)), "validCount": n, "min": F.coalesce(F.min(v), nan), "max": F.coalesce(F.max(v), nan), "mean": F.coalesce(F.avg(v), nan),
            "stddev": F.when(n < 2, nan).otherwise(F.stddev_pop(v)),
        }
        ranked = (lambda p: F.percentile(v, F.lit(p))) if exact else (lambda p: F.percentile_approx(v, F.lit(p), F.lit(100_000)))
        return out | {f"p{p:g}": ranked(p) for p in self.percentiles}

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        out = None
        for k, s in enumerate(self.inputs()):
            label = self.column_names[k] if s.describe(ctx).kind == "raster" and k < len(self.column_names) else None
            own = series(s, ctx, rect, self.column_names or None if s.describe(ctx).kind == "vector" else None, label)
            df = own[0][1]
            exact = not self.percentiles or df.limit(self.EXACT + 1).count() <= self.EXACT
            row = df.agg(*[F.struct(F.lit(name).alias("name"), *[c.alias(m) for m, c in self._measures(v, exact).items()]).alias(f"s{i}") for i, (name, _, v) in enumerate(own)])
            part = row.select(F.explode(F.array(*[f"s{i}" for i in range(len(own))])).alias("s")).select("s.*")
            out = part if out is None else out.unionByName(part)
        return out

    def document(self, ctx: Context, rect: Rect) -> dict:
        rows = [r.asDict() for r in self.query(ctx, rect).collect()]
        return {r["name"]: {k: v for k, v in r.items() if k != "name" and not k.startswith("p")} | {"percentiles": [{"percentile": p, "value": r[f"p{p:g}"]} for p in self.percentiles]} for r in rows}


@dataclass(frozen=True)
class Histogram(Plot):
    """Counts in buckets of equal width.

    bounds: "data" or {"min", "max"}; buckets: {"type": "number", "value"} or {"type": "squareRootChoiceRule", "maxNumberOfBuckets"}.  Values outside are left out;
    what is no finite number counts as no data.
    """

    TYPE: ClassVar[str] = "Histogram"
    INPUTS: ClassVar[tuple[str, ...]] = ("source",)
    source: Operator
    attribute_name: str | None = None
    bounds: Any = field(default="data", hash=False)
    buckets: dict = field(default_factory=lambda: {"type": "squareRootChoiceRule", "maxNumberOfBuckets": 100}, hash=False)
    interactive: bool = False

    def check(self, ctx: Context) -> None:
        series(self.source, ctx, Rect(), (self.attribute_name,) if self.attribute_name else None, self.attribute_name)

    def _values(self, ctx: Context, rect: Rect) -> DataFrame:
        _, df, v = series(self.source, ctx, rect, (self.attribute_name,) if self.attribute_name else None, self.attribute_name)[0]
        return df.select(finite(v).alias("v"))

    def _plan(self, values: DataFrame) -> tuple[float, float, int]:
        given = isinstance(self.bounds, dict)
        if given and self.buckets["type"] == "number":
            low, high, n = self.bounds["min"], self.bounds["max"], 1
        else:
            low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
            if given:
                low, high = self.bounds["min"], self.bounds["max"]
        if not n:
            return (float(self.bounds["min"]), float(self.bounds["max"]), 1) if given else (0.0, 0.0, 1)
        count = self.buckets["value"] if self.buckets["type"] == "number" else min(math.isqrt(n), self.buckets.get("maxNumberOfBuckets", 100))
        if math.isclose(low, high):
            count = 1
        return float(low), float(high), max(1, count)

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        values = self._values(ctx, rect)
        low, high, n = self._plan(values)
        width = (high - low) / n
        share = (F.col("v") - low) / (high - low) * n if high > low else F.lit(0.0)
        bucket = F.least(F.floor(share), F.lit(n - 1)).cast("int")
        counted = values.where(F.col("v").between(low, high)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        every = ctx.spark.range(n).select(F.col("id").cast("int").alias("bucket"))
        return every.join(counted, "bucket", "left").select("bucket", (F.lit(low) + F.col("bucket") * width).alias("bucket_start"), (F.lit(low) + (F.col("bucket") + 1) * width).alias("bucket_end"), F.coalesce("n", F.lit(0)).alias("frequency"))

    def document(self, ctx: Context, rect: Rect) -> dict:
        no_data = self._values(ctx, rect).where("v is null").count()
        return vega.histogram([r.asDict() for r in self.query(ctx, rect).orderBy("bucket").collect()], no_data, self.interactive)


@dataclass(frozen=True)
class ClassHistogram(Plot):
    """Counts for each declared class, 0 included; other values are left out."""

    TYPE: ClassVar[str] = "ClassHistogram"
    INPUTS: ClassVar[tuple[str, ...]] = ("source",)
    source: Operator
    column_name: str | None = None

    def _classes(self, ctx: Context) -> tuple[tuple[int, str], ...]:
        desc = self.source.describe(ctx)
        if desc.kind == "raster":
            if len(desc.bands) != 1:
                raise GraphError("one band is needed")
            m = desc.bands[0].measurement
        else:
            m = desc.measurements.get(self.column_name)
        if m is None or m.kind != "classification":
            raise GraphError("a classification is needed")
        return m.classes

    def check(self, ctx: Context) -> None:
        self._classes(ctx)

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        classes = ctx.spark.createDataFrame(list(self._classes(ctx)), "class_id int, label string")
        raster = self.source.describe(ctx).kind == "raster"
        df = self.source.query(ctx, rect if raster else rect.but(columns=(self.column_name,)))
        value = F.col("value" if raster else self.column_name)
        counted = df.where(value.between(0, 255)).groupBy(F.floor(value).cast("int").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
        return classes.join(counted, "class_id", "left").select("class_id", "label", F.coalesce("n", F.lit(0)).alias("frequency"))

    def document(self, ctx: Context, rect: Rect) -> dict:
        return vega.bars([(r["label"], r["frequency"]) for r in self.query(ctx, rect).orderBy("class_id").collect()])


@dataclass(frozen=True)
class PieChart(Plot):
    """Counts by value; NULL and empty strings are left out.  More than 32 slices are an error."""

    TYPE: ClassVar[str] = "PieChart"
    INPUTS: ClassVar[tuple[str, ...]] = ("vector",)
    vector: Operator
    column_name: str = ""
    type: str = "count"
    donut: bool = False
    MOST: ClassVar[int] = 32

    def check(self, ctx: Context) -> None:
        if self.column_name not in self.vector.describe(ctx).columns:
            raise GraphError(f"unknown column {self.column_name!r}")

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        desc = self.vector.describe(ctx)
        m = desc.measurements.get(self.column_name)
        value = F.col(self.column_name)
        if m is not None and m.kind == "classification":
            value = F.coalesce(*[F.when(value == k, F.lit(label)) for k, label in m.classes])
        own = self.vector.query(ctx, rect.but(columns=(self.column_name,))).select(value.cast("string").alias("slice"))
        return own.where("slice is not null and slice != ''").groupBy("slice").agg(F.count(F.lit(1)).alias("n"))

    def document(self, ctx: Context, rect: Rect) -> dict:
        rows = self.query(ctx, rect).limit(self.MOST + 1).collect()
        if len(rows) > self.MOST:
            raise GraphError("too many slices")
        return vega.pie(sorted((r["slice"], r["n"]) for r in rows), self.donut)


CUTS = 1000  # pieces that a sketch cuts values into


@dataclass(frozen=True)
class Interval:
    """An open interval of a column's values: how many lie below and inside, which ranks (from 1) it holds, and a sketch of the values inside."""

    name: str
    low: float
    high: float
    below: int
    inside: int
    ranks: tuple[int, ...]
    sketch: list[float] | None = None

    def cuts(self) -> list[float]:
        """For each rank, a value from the sketch on either side."""
        steps = [int((r - self.below) * CUTS / self.inside) for r in self.ranks]
        return sorted({self.sketch[min(max(k, 0), CUTS)] for s in steps for k in (s - 1, s + 2)})


def sketch() -> Column:
    """Values at every thousandth of the ranks, a tenth of a step off at most."""
    return F.percentile_approx("v", [k / CUTS for k in range(CUTS + 1)], 10 * CUTS)


def ranked(ctx: Context, values: DataFrame, intervals: list[Interval], most: int) -> dict[tuple[str, int], float]:
    """The exact value at each rank of each column of ``values`` (name, v).

    A sketch only says where to cut an interval; values are counted between the cuts and at them.  So a rank is found at a cut, or its interval shrinks,
    until it holds ``most`` values, which are sorted.  No task holds more of a column.
    """

    def within(some: list[Interval], schema: str, extra: Callable[[Interval], list]) -> DataFrame:
        table = ctx.spark.createDataFrame([(k, i.name, i.low, i.high, extra(i)) for k, i in enumerate(some)], f"k int, name string, low double, high double, {schema}")
        return values.join(F.broadcast(table), "name").where("v > low and v < high")  # six rows a column at most

    out, small = {}, []
    while intervals:
        small += [i for i in intervals if i.inside <= most]
        large = [i for i in intervals if i.inside > most]
        intervals = []
        if not large:
            break
        if not all(i.sketch for i in large):
            found = {r.k: r.s for r in within(large, "ranks array<long>", lambda i: list(i.ranks)).groupBy("k").agg(sketch().alias("s")).collect()}
            large = [replace(i, sketch=found[k]) for k, i in enumerate(large)]
        passed = lambda test: F.size(F.filter("cuts", test))
        piece = passed(lambda c: c < F.col("v")) + passed(lambda c: c <= F.col("v"))  # odd at a cut, even between two
        counts: dict[int, dict[int, int]] = {}
        for r in within(large, "cuts array<double>", Interval.cuts).groupBy("k", piece.alias("piece")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(r.k, {})[r.piece] = r.n
        for k, i in enumerate(large):
            cuts, below = i.cuts(), i.below
            for p, n in sorted(counts[k].items()):
                own = tuple(r for r in i.ranks if below < r <= below + n)
                if p % 2:
                    out |= {(i.name, r): cuts[p // 2] for r in own}
                elif own:
                    ends = [i.low, *cuts, i.high]
                    intervals.append(Interval(i.name, ends[p // 2], ends[p // 2 + 1], below, n, own))
                below += n
    if small:
        lists = within(small, "places array<int>", lambda i: [r - i.below for r in i.ranks]).groupBy("k", "places").agg(F.sort_array(F.collect_list("v")).alias("s"))
        at = F.transform("places", lambda p: F.element_at("s", p))
        for r in lists.select("k", at.alias("found")).collect():
            out |= {(small[r.k].name, rank): v for rank, v in zip(small[r.k].ranks, r.found, strict=True)}
    return out


@dataclass(frozen=True)
class BoxPlot(Plot):
    """min, q1, median, q3, max of finite values, exact however many they are.

    Halves leave out the median if the count is odd.  Attributes without values are left out.
    """

    TYPE: ClassVar[str] = "BoxPlot"
    INPUTS: ClassVar[tuple[str, ...]] = ("source",)
    source: Operator | tuple[Operator, ...]
    column_names: tuple[str, ...] = ()
    SORTED: ClassVar[int] = 10_000

    def check(self, ctx: Context) -> None:
        if len(self.inputs()) > 8:
            raise GraphError("at most eight rasters")

    def _long(self, ctx: Context, rect: Rect) -> DataFrame:
        out = None
        for k, s in enumerate(self.inputs()):
            label = self.column_names[k] if s.describe(ctx).kind == "raster" and k < len(self.column_names) else None
            own = series(s, ctx, rect, self.column_names or None if s.describe(ctx).kind == "vector" else None, label)
            pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), finite(v).alias("v")) for n, _, v in own]))
            part = own[0][1].select(pairs.alias("s")).select("s.*").where("v is not null")
            out = part if out is None else out.unionByName(part)
        return out

    @staticmethod
    def _ranks(n: int) -> tuple[tuple[int, int], ...]:
        """The two ranks in the middle of the lower half, of all, and of the upper half."""
        half = max(n // 2, 1)
        return tuple((first + (m - 1) // 2, first + m // 2) for first, m in ((1, half), (1, n), (n - half + 1, half)))

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        long = self._long(ctx, rect)
        found = long.groupBy("name").agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), sketch().alias("s")).collect()
        whole = [Interval(r.name, -math.inf, math.inf, 0, r.n, tuple(sorted({k for pair in self._ranks(r.n) for k in pair})), r.s) for r in found]
        at = ranked(ctx, long, whole, self.SORTED)
        mid = lambda a, b: a if a == b else a / 2 + b / 2 if math.isinf(a + b) else (a + b) / 2
        rows = [(r.name, r.min, *[mid(at[r.name, a], at[r.name, b]) for a, b in self._ranks(r.n)], r.max, True) for r in found]
        return ctx.spark.createDataFrame(rows, "name string, min double, q1 double, median double, q3 double, max double, is_exact boolean")

    def document(self, ctx: Context, rect: Rect) -> dict:
        return vega.boxes([r.asDict() for r in self.query(ctx, rect).orderBy("name").collect()])


@dataclass(frozen=True)
class ScatterPlot(Plot):
    """Pairs of finite values: up to 500 as points, more as a histogram of two dimensions over the bounds of all pairs."""

    TYPE: ClassVar[str] = "ScatterPlot"
    INPUTS: ClassVar[tuple[str, ...]] = ("vector",)
    vector: Operator
    column_x: str = ""
    column_y: str = ""
    POINTS: ClassVar[int] = 500
    SIDE: ClassVar[int] = 100

    def check(self, ctx: Context) -> None:
        series(self.vector, ctx, Rect(), (self.column_x, self.column_y))

    def pairs(self, ctx: Context, rect: Rect) -> DataFrame:
        df = self.vector.query(ctx, rect.but(columns=(self.column_x, self.column_y)))
        return df.select(finite(F.col(self.column_x)).alias("x"), finite(F.col(self.column_y)).alias("y")).where("x is not null and y is not null")

    def bounds(self, ctx: Context, rect: Rect) -> tuple:
        return tuple(self.pairs(ctx, rect).agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        n, x0, x1, y0, y1 = self.bounds(ctx, rect)
        pairs = self.pairs(ctx, rect)
        if n <= self.POINTS:
            return pairs
        side = min(self.SIDE, math.isqrt(n))
        at = lambda c, low, high: F.least(F.floor((F.col(c) - low) / ((high - low) or 1.0) * side), F.lit(side - 1)).cast("int")
        return pairs.groupBy(at("x", x0, x1).alias("bucket_x"), at("y", y0, y1).alias("bucket_y")).agg(F.count(F.lit(1)).alias("n"))

    def document(self, ctx: Context, rect: Rect) -> dict:
        n, x0, x1, y0, y1 = self.bounds(ctx, rect)
        rows = [r.asDict() for r in self.query(ctx, rect).collect()]
        return vega.scatter(rows, self.column_x, self.column_y) if n <= self.POINTS else vega.heat(rows, (x0, x1, y0, y1), min(self.SIDE, math.isqrt(n)), self.column_x, self.column_y)


@dataclass(frozen=True)
class MeanRasterPixelValuesOverTime(Plot):
    """Mean of all pixels with data for each slice; its place in time is start, end or center."""

    TYPE: ClassVar[str] = "MeanRasterPixelValuesOverTime"
    INPUTS: ClassVar[tuple[str, ...]] = ("raster",)
    raster: Operator
    time_position: str = "start"
    area: bool = True

    def check(self, ctx: Context) -> None:
        if self.time_position not in ("start", "center", "end"):
            raise GraphError(f"unknown position {self.time_position!r}")

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        t = {"start": F.col("t_start"), "end": F.col("t_end"), "center": F.floor((F.col("t_start") + F.col("t_end")) / 2)}[self.time_position]
        df = self.raster.query(ctx, rect.but(bands=(0,)))
        return df.where("value is not null").groupBy(t.cast("long").alias("t")).agg(F.avg(F.col("value").cast("double")).alias("mean"))

    def document(self, ctx: Context, rect: Rect) -> dict:
        return vega.line([(r["t"], r["mean"]) for r in self.query(ctx, rect).orderBy("t").collect()], self.area)


@dataclass(frozen=True)
class FeatureAttributeValuesOverTime(Plot):
    """Series of a value for each id, by the start of its time.  The first 20 ids (by time, then id) are shown; empty ids and NULL values are left out."""

    TYPE: ClassVar[str] = "FeatureAttributeValuesOverTime"
    INPUTS: ClassVar[tuple[str, ...]] = ("vector",)
    vector: Operator
    id_column: str = ""
    value_column: str = ""
    SERIES: ClassVar[int] = 20

    def check(self, ctx: Context) -> None:
        columns = self.vector.describe(ctx).columns
        if self.id_column not in columns or columns.get(self.value_column) not in ("int", "float"):
            raise GraphError("an id and a number are needed")

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        df = self.vector.query(ctx, rect.but(columns=(self.id_column, self.value_column)))
        rows = df.select(F.col(self.id_column).cast("string").alias("series"), F.col("t_start").alias("t"), F.col(self.value_column).alias("value")).where("series is not null and series != '' and value is not null")
        first = rows.groupBy("series").agg(F.min("t").alias("first")).orderBy("first", "series").limit(self.SERIES).select("series")
        return rows.join(F.broadcast(first), "series", "left_semi")  # twenty rows

    def document(self, ctx: Context, rect: Rect) -> dict:
        return vega.lines([(r["series"], r["t"], r["value"]) for r in self.query(ctx, rect).orderBy("series", "t").collect()])


