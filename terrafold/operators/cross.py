"""Operators between features and pixels."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.engine.graph import Context, GraphError, Operator, need
from terrafold.functions import geometry
from terrafold.model.descriptor import Band, GeoTransform, RasterDescriptor, VectorDescriptor, is_float
from terrafold.model.rect import Rect
from terrafold.model.time import MAX_MS, MIN_MS, intersects


def gaussian(x: float, stddev: float) -> float:
    return math.exp(-(x * x) / (2 * stddev * stddev)) / (math.sqrt(2 * math.pi) * stddev)


def gaussian_reach(cutoff: float, stddev: float) -> float:
    """Distance at which the density has fallen to ``cutoff`` of its peak."""
    return stddev * math.sqrt(2 * math.log(1 / cutoff))


@dataclass(frozen=True)
class Rasterization(Operator):
    """Points as pixels: counts of a grid, or a density of Gaussians cut off at a radius.

    mode grid: a cell without points is 0.  mode density: cutoff (share of the peak) and stddev; distances go to pixel centres.
    spatial_resolution: x and y; origin: x and y.  Features without points give zeros.  The result has one slice: the query's time.
    """

    TYPE: ClassVar[str] = "Rasterization"
    INPUTS: ClassVar[tuple[str, ...]] = ("vector",)
    vector: Operator
    spatial_resolution: dict = field(hash=False)
    mode: str = "grid"
    origin: tuple[float, float] = (0.0, 0.0)
    cutoff: float = 0.01
    stddev: float = 1.0

    def describe(self, ctx: Context) -> RasterDescriptor:
        desc = need("vector", self.vector, ctx)
        x, y = self.spatial_resolution["x"], self.spatial_resolution["y"]
        if x <= 0 or y <= 0:
            raise GraphError("a resolution is positive")
        if self.mode not in ("grid", "density"):
            raise GraphError(f"unknown mode {self.mode!r}")
        if self.mode == "density" and not (0 <= self.cutoff < 1 and self.stddev > 0):
            raise GraphError("0 <= cutoff < 1 and stddev > 0")
        t = GeoTransform(*self.origin, x, -y)
        return RasterDescriptor("F64", t, (math.floor((self.origin[1] - 90) / y), math.ceil((self.origin[1] + 90) / y) - 1, math.floor((-180 - self.origin[0]) / x), math.ceil((180 - self.origin[0]) / x) - 1), (Band("count" if self.mode == "grid" else "density"),), srs=desc.srs)

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        from terrafold.sources.tables import dense

        desc, kind = self.describe(ctx), need("vector", self.vector, ctx).geometry
        rect = rect.on_grid(desc.transform)
        a, b, c, d = pixels = rect.pixels or desc.pixels
        t = desc.transform
        grid = dense(ctx, ctx.spark.createDataFrame([rect.time], "t_start long, t_end long"), pixels, 1)
        if kind != "MultiPoint":
            return grid.withColumn("value", F.lit(0.0))
        reach = 0.0
        if self.mode == "density":
            rounding = max(1 / abs(t.x_size), 1 / abs(t.y_size))
            reach = math.ceil(gaussian_reach(self.cutoff, self.stddev) * rounding) / rounding
        box = (t.x + c * t.x_size - reach, t.y + (b + 1) * t.y_size - reach, t.x + (d + 1) * t.x_size + reach, t.y + a * t.y_size + reach)
        points = self.vector.query(ctx, rect.but(bbox=box, pixels=None, bands=None, columns=())).select(F.explode("geom").alias("p"))
        row, col = F.floor((F.col("p.y") - t.y) / t.y_size).cast("int"), F.floor((F.col("p.x") - t.x) / t.x_size).cast("int")
        if self.mode == "grid":
            hit = points.select(row.alias("y"), col.alias("x")).groupBy("y", "x").agg(F.count(F.lit(1)).cast("double").alias("v"))
        else:
            # every point adds to the pixels of a square around it that lie inside the radius
            ry, rx = math.ceil(reach / abs(t.y_size)) + 1, math.ceil(reach / abs(t.x_size)) + 1
            near = points.select("p", F.explode(F.sequence(row - ry, row + ry)).alias("y"), col.alias("col")).select("p", "y", F.explode(F.sequence(F.col("col") - rx, F.col("col") + rx)).alias("x"))
            dx, dy = F.col("p.x") - (t.x + (F.col("x") + 0.5) * t.x_size), F.col("p.y") - (t.y + (F.col("y") + 0.5) * t.y_size)
            near = near.withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= reach)
            density = F.exp(-(F.col("d") * F.col("d")) / (2 * self.stddev**2)) / (math.sqrt(2 * math.pi) * self.stddev)
            hit = near.groupBy("y", "x").agg(F.sum(density).alias("v"))
        return grid.join(hit, ["y", "x"], "left").select("t_start", "t_end", "band", "y", "x", F.coalesce("v", F.lit(0.0)).alias("value"))


def column_names(parts: list[list[str]], taken: list[str], rule: dict | None) -> list[list[str]]:
    """Names of new columns: default, suffix or names, as for stacked bands; none may be taken."""
    rule, used, out = rule or {"type": "default"}, set(taken), []
    for k, own in enumerate(parts):
        mine = []
        for i, n in enumerate(own):
            if rule["type"] == "names":
                name = rule["values"][sum(map(len, parts[:k])) + i]
            elif rule["type"] == "suffix":
                name = f"{n}{rule['values'][k]}"
            else:
                name, j = n, 1
                while name in used:
                    name, j = f"{n} ({j})", j + 1
            if name in used:
                raise GraphError(f"column {name!r} exists")
            used.add(name)
            mine.append(name)
        out.append(mine)
    return out


@dataclass(frozen=True)
class RasterVectorJoin(Operator):
    """Raster values as columns of features.

    feature_aggregation: first or mean over the pixels that a feature covers.  temporal_aggregation: none splits a feature by the raster's slices; first or
    mean combine them.  Polygons cover the pixels whose upper left corner lies inside.  Without pixels first and mean over time give 0.
    Pixels are matched by equal row, column and step of time; times are compared within such a cell.
    """

    TYPE: ClassVar[str] = "RasterVectorJoin"
    INPUTS: ClassVar[tuple[str, ...]] = ("vector", "rasters")
    vector: Operator
    rasters: tuple[Operator, ...]
    names: dict | None = field(default=None, hash=False)
    feature_aggregation: str = "first"
    feature_aggregation_ignore_no_data: bool = False
    temporal_aggregation: str = "none"
    temporal_aggregation_ignore_no_data: bool = False

    def _names(self, ctx: Context) -> list[list[str]]:
        desc = need("vector", self.vector, ctx)
        return column_names([[b.name for b in need("raster", r, ctx).bands] for r in self.rasters], list(desc.columns), self.names)

    def describe(self, ctx: Context) -> VectorDescriptor:
        desc = need("vector", self.vector, ctx)
        if desc.geometry == "Data":
            raise GraphError("data rows have no place")
        if desc.geometry == "MultiLineString":
            raise NotImplementedError("lines cover no pixels")
        if not 1 <= len(self.rasters) <= 8:
            raise GraphError("one to eight rasters")
        if self.feature_aggregation not in ("first", "mean") or self.temporal_aggregation not in ("none", "first", "mean"):
            raise GraphError("unknown aggregation")
        columns = dict(desc.columns)
        for r, own in zip(self.rasters, self._names(ctx), strict=True):
            whole = not is_float(need("raster", r, ctx).data_type) and self.feature_aggregation == "first" and self.temporal_aggregation != "mean"
            columns |= dict.fromkeys(own, "int" if whole else "float")
        return desc.but(columns=columns)

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        types = self.describe(ctx).columns
        desc = need("vector", self.vector, ctx)
        found = self.vector.query(ctx, rect.but(columns=None))
        for raster, names in zip(self.rasters, self._names(ctx), strict=True):
            found = self._joined(ctx, found, desc.geometry, raster, names, types, rect)
        return found if rect.columns is None else found.select("t_start", "t_end", "geom", *[c for c in types if c in rect.columns])

    def _covered(self, found: DataFrame, kind: str, t: GeoTransform) -> DataFrame:
        """__id, i (order of pixels within a feature), y, x."""
        row = lambda v: F.floor((v - t.y) / t.y_size).cast("int")
        col = lambda v: F.floor((v - t.x) / t.x_size).cast("int")
        if kind == "MultiPoint":
            return found.select("__id", "t_start", "t_end", F.posexplode("geom").alias("i", "p")).select("__id", "t_start", "t_end", "i", row(F.col("p.y")).alias("y"), col(F.col("p.x")).alias("x"))
        x0, y0, x1, y1 = geometry.bounds(F.col("geom"), kind)
        ends = lambda a, b: (F.least(a, b), F.greatest(a, b))
        (ra, rb), (ca, cb) = ends(row(y0), row(y1)), ends(col(x0), col(x1))
        cells = found.select("__id", "t_start", "t_end", "geom", F.explode(F.sequence(ra, rb)).alias("y"), ca.alias("ca"), cb.alias("cb")).select("__id", "t_start", "t_end", "geom", "y", F.explode(F.sequence(F.col("ca"), F.col("cb"))).alias("x"))
        inside = geometry.in_polygons(F.col("geom"), t.x + F.col("x") * t.x_size, t.y + F.col("y") * t.y_size)
        return cells.where(inside).select("__id", "t_start", "t_end", F.struct("y", "x").alias("i"), "y", "x")

    def _combined(self, how: str, ignore: bool, value: Column, order: Column) -> Column:
        """first or mean of a group."""
        if how == "first":
            return F.min_by(value, F.when(value.isNotNull(), order) if ignore else order)
        mean = F.avg(value)
        return mean if ignore else F.when(F.count(value) == F.count(F.lit(1)), mean)

    def _joined(self, ctx: Context, found: DataFrame, kind: str, raster: Operator, names: list[str], types: dict, rect: Rect) -> DataFrame:
        rdesc = need("raster", raster, ctx)
        pixels = raster.query(ctx, rect.on_grid(rdesc.transform).but(bbox=None, columns=None, bands=None))
        # values of all bands side by side: one row for each pixel and slice
        n = len(names)
        value = lambda k: F.max(F.when(F.col("band") == k, F.col("value"))).cast("double").alias(f"v{k}")
        wide = pixels.select("t_start", "t_end", "y", "x", F.col("value").cast("double").alias("v0")) if n == 1 else pixels.groupBy("t_start", "t_end", "y", "x").agg(*map(value, range(n)))
        wide = wide.withColumnsRenamed({"t_start": "r_start", "t_end": "r_end"})
        first, last = self._buckets(rdesc, rect)
        wide = wide.withColumn("r_first", first("r_start", "r_end")).withColumn("bucket", F.explode(F.sequence("r_first", F.greatest("r_first", last("r_start", "r_end")))))
        cast = lambda k, c: (c.cast("bigint") if types[names[k]] == "int" else c).alias(names[k])
        if kind != "MultiPoint":
            return self._general(found, kind, rdesc, wide, first, last, n, cast)
        # a feature of one point in one bucket meets the slices of one pixel and bucket: one join keeps all rows
        rows = found.withColumns({"__first": first("t_start", "t_end"), "__last": last("t_start", "t_end")})
        single = (F.size("geom") == 1) & (F.col("__last") <= F.col("__first"))
        near = self._single(rows.where(single), rdesc, wide, found.columns, n, cast)
        return near.unionByName(self._general(rows.where(~F.coalesce(single, F.lit(False))).select(found.columns), kind, rdesc, wide, first, last, n, cast))

    def _buckets(self, rdesc: RasterDescriptor, rect: Rect) -> tuple[Callable, Callable]:
        """Numbers of the first and last step of the raster that an interval meets, inside the time that bounds the query; 0 if nothing does or there are no steps.

        Two intervals that meet inside these bounds share a bucket there, so it can be part of a join's key.
        """
        time = rect.time if rect.time != (MIN_MS, MAX_MS) else rdesc.time
        if rdesc.step is None or time is None or time[0] <= MIN_MS or time[1] >= MAX_MS:
            return (lambda a, b: F.lit(0).cast("long")), (lambda a, b: F.lit(0).cast("long"))
        low, high = F.lit(time[0]), F.lit(max(time[0], time[1] - 1))
        number = lambda t: rdesc.step.index(F.least(F.greatest(t, low), high), rdesc.reference).cast("long")
        return (lambda a, b: number(F.col(a))), (lambda a, b: number(F.greatest(F.col(a), F.col(b) - 1)))

    def _single(self, rows: DataFrame, rdesc: RasterDescriptor, wide: DataFrame, columns: list[str], n: int, cast: Callable) -> DataFrame:
        """Features of one point in one bucket: joined with all slices of their pixel and bucket, of which they keep what they meet."""
        t = rdesc.transform
        p = F.col("geom")[0]
        rows = rows.withColumns({"__y": F.floor((p["y"] - t.y) / t.y_size).cast("int"), "__x": F.floor((p["x"] - t.x) / t.x_size).cast("int")})
        slices = wide.groupBy("y", "x", "bucket").agg(F.array_sort(F.collect_list(F.struct("r_start", "r_end", *[f"v{k}" for k in range(n)]))).alias("slices"))
        joined = rows.join(slices, (F.col("__y") == F.col("y")) & (F.col("__x") == F.col("x")) & (F.col("__first") == F.col("bucket")), "left")
        hits = F.filter("slices", lambda s: intersects(F.col("t_start"), F.col("t_end"), s["r_start"], s["r_end"]))
        rest = [c for c in columns if c not in ("t_start", "t_end")]
        if self.temporal_aggregation == "none":
            spread = joined.select(*columns, F.explode_outer(hits).alias("s"))
            start, end = (F.coalesce(f(c, f"s.{r}"), F.col(c)) for f, c, r in ((F.greatest, "t_start", "r_start"), (F.least, "t_end", "r_end")))
            return spread.select(start.alias("t_start"), end.alias("t_end"), *rest, *[cast(k, F.col(f"s.v{k}")) for k in range(n)])
        joined = joined.select(*columns, F.coalesce(hits, F.array().cast(joined.schema["slices"].dataType)).alias("s"))
        ignore = self.temporal_aggregation_ignore_no_data

        def combined(k: int) -> Column:
            own = F.transform("s", lambda s: s[f"v{k}"])
            known = F.filter(own, lambda v: v.isNotNull())
            if self.temporal_aggregation == "first":
                out = F.get(known if ignore else own, F.lit(0))
            else:
                total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
                out = F.when((F.size(known) > 0) if ignore else (F.size(known) == F.size(own)), F.try_divide(total, F.size(known)))
            return F.coalesce(out, F.lit(0.0)) if ignore else F.when(F.size("s") == 0, 0.0).otherwise(out)

        return joined.select(*columns, *[cast(k, combined(k)) for k in range(n)])

    def _general(self, found: DataFrame, kind: str, rdesc: RasterDescriptor, wide: DataFrame, first: Callable, last: Callable, n: int, cast: Callable) -> DataFrame:
        """Features of several pixels or buckets: pixels that they cover, combined for each feature and slice, then joined back."""
        from terrafold.sources.tables import identity

        rows = found.withColumn("__id", identity(found.columns))
        covered = self._covered(rows, kind, rdesc.transform).withColumn("f_first", first("t_start", "t_end"))
        covered = covered.withColumn("bucket", F.explode(F.sequence("f_first", F.greatest("f_first", last("t_start", "t_end")))))
        # a pair that shares several buckets counts in the first of them
        meets = intersects(F.col("t_start"), F.col("t_end"), F.col("r_start"), F.col("r_end")) & (F.col("bucket") == F.greatest("f_first", "r_first"))
        hits = covered.join(wide, ["y", "x", "bucket"]).where(meets)
        per_slice = hits.groupBy("__id", "r_start", "r_end").agg(*[self._combined(self.feature_aggregation, self.feature_aggregation_ignore_no_data, F.col(f"v{k}"), F.col("i")).alias(f"v{k}") for k in range(n)])
        if self.temporal_aggregation == "none":
            joined = rows.join(per_slice, "__id", "left")
            start = F.when(F.col("r_start").isNull(), F.col("t_start")).otherwise(F.greatest("t_start", "r_start"))
            end = F.when(F.col("r_end").isNull(), F.col("t_end")).otherwise(F.least("t_end", "r_end"))
            return joined.select(start.alias("t_start"), end.alias("t_end"), *[c for c in found.columns if c not in ("t_start", "t_end")], *[cast(k, F.col(f"v{k}")) for k in range(n)])
        over = [self._combined(self.temporal_aggregation, self.temporal_aggregation_ignore_no_data, F.col(f"v{k}"), F.struct("r_start", "r_end")).alias(f"v{k}") for k in range(n)]
        total = per_slice.groupBy("__id").agg(*over, F.lit(True).alias("hit"))
        zero = lambda k: F.coalesce(F.col(f"v{k}"), F.lit(0.0)) if self.temporal_aggregation_ignore_no_data else F.when(F.col("hit").isNull(), 0.0).otherwise(F.col(f"v{k}"))
        return rows.join(total, "__id", "left").select(*found.columns, *[cast(k, zero(k)) for k in range(n)])
