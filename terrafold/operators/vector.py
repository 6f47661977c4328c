"""Operators on features."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.engine.graph import Context, GraphError, Operator, need
from terrafold.functions import expression, geometry, projection
from terrafold.model.descriptor import VectorDescriptor
from terrafold.model.rect import Rect
from terrafold.model.time import MAX_MS, MIN_MS, TimeStep, intersects, to_ms

NUMERIC = ("int", "float")


def range_predicate(column: Column, ranges: Any, keep_nulls: bool) -> Column:
    """Inside any of the inclusive ranges; NULL only if asked for."""
    if not ranges:
        raise GraphError("ranges must not be empty")
    inside = functools.reduce(operator.or_, [column.between(low, high) for low, high in ranges])
    return inside | column.isNull() if keep_nulls else inside


@dataclass(frozen=True)
class ColumnRangeFilter(Operator):
    """Features whose column lies in one of the ranges."""

    TYPE: ClassVar[str] = "ColumnRangeFilter"
    INPUTS: ClassVar[tuple[str, ...]] = ("vector",)
    vector: Operator
    column: str
    ranges: tuple
    keep_nulls: bool = False

    def describe(self, ctx: Context) -> VectorDescriptor:
        desc = need("vector", self.vector, ctx)
        if self.column not in desc.columns:
            raise GraphError(f"unknown column {self.column!r}")
        if desc.columns[self.column] == "category":
            raise GraphError("categories have no ranges")
        range_predicate(F.lit(0), self.ranges, False)
        return desc

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        kind = self.describe(ctx).columns[self.column]
        column = F.col(self.column)
        if kind == "bool":
            column = column.cast("int")
        elif kind == "datetime":
            column = F.unix_millis(column)
        asked = rect if rect.columns is None else rect.but(columns=(*rect.columns, self.column))
        found = self.vector.query(ctx, asked).where(range_predicate(column, self.ranges, self.keep_nulls))
        return found if rect.columns is None or self.column in rect.columns else found.drop(self.column)


@dataclass(frozen=True)
class TimeProjection(Operator):
    """Time snapped outwards to steps: the start down, the end up unless it is on a step already."""

    TYPE: ClassVar[str] = "TimeProjection"
    INPUTS: ClassVar[tuple[str, ...]] = ("vector",)
    vector: Operator
    step: TimeStep | dict
    step_reference: int | str | None = None

    def describe(self, ctx: Context) -> VectorDescriptor:
        TimeStep.of(self.step)
        return need("vector", self.vector, ctx)

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        step, ref = TimeStep.of(self.step), to_ms(self.step_reference or 0)
        low, high = step.snap_ms(rect.time[0], ref), step.snap_ms(rect.time[1], ref)
        time = (low, high if high == rect.time[1] else step.add_ms(high))
        found = self.vector.query(ctx, rect.but(time=time)).withColumns({"t_start": step.snap(F.col("t_start"), ref), "__end": step.snap(F.col("t_end"), ref)})
        return found.withColumn("t_end", F.when(F.col("__end") == F.col("t_end"), F.col("t_end")).otherwise(step.add(F.col("__end")))).drop("__end")


@dataclass(frozen=True)
class TimeShift(Operator):
    """The source at another time, shown at the time of the query.

    kind relative: granularity and value steps; kind absolute: time_interval (start, end) replaces the query's.
    """

    TYPE: ClassVar[str] = "TimeShift"
    INPUTS: ClassVar[tuple[str, ...]] = ("source",)
    source: Operator
    kind: str = "relative"
    granularity: str = "days"
    value: int = 0
    time_interval: tuple | None = None

    def describe(self, ctx: Context) -> Any:
        if self.kind not in ("relative", "absolute") or (self.kind == "absolute" and not self.time_interval):
            raise GraphError("a shift is relative, or absolute with an interval")
        desc = self.source.describe(ctx)
        return desc.but(time=None) if desc.kind == "raster" else desc

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        start, end = rect.time
        if self.kind == "absolute":
            own = (to_ms(self.time_interval[0]), to_ms(self.time_interval[1]))
            a, b = start - own[0], end - own[1]
            moved = {"t_start": F.col("t_start") + a, "t_end": F.col("t_end") + b}
            found = self.source.query(ctx, rect.but(time=own))
            # an interval must not end before it starts
            return found.withColumns(moved).withColumn("t_end", F.when(F.col("t_end") >= F.col("t_start"), F.col("t_end")).otherwise(F.raise_error(F.lit("a shifted interval ends before it starts"))))
        if not self.value:
            return self.source.query(ctx, rect)
        step = TimeStep(self.granularity.lower(), abs(self.value))
        n = 1 if self.value > 0 else -1
        found = self.source.query(ctx, rect.but(time=(step.add_ms(start, n), step.add_ms(end, n))))
        return found.withColumns({"t_start": step.add(F.col("t_start"), -n), "t_end": step.add(F.col("t_end"), -n)})


@dataclass(frozen=True)
class VectorJoin(Operator):
    """Inner join of features with data rows of equal keys whose times intersect; the result holds for both times."""

    TYPE: ClassVar[str] = "VectorJoin"
    INPUTS: ClassVar[tuple[str, ...]] = ("left", "right")
    left: Operator
    right: Operator
    left_column: str
    right_column: str
    right_column_suffix: str = "right"

    def _names(self, left: VectorDescriptor, right: VectorDescriptor) -> dict[str, str]:
        names, used = {}, set(left.columns)
        for c in right.columns:
            name = c
            while name in used:
                name += self.right_column_suffix
            used.add(name)
            names[c] = name
        return names

    def describe(self, ctx: Context) -> VectorDescriptor:
        left, right = need("vector", self.left, ctx), need("vector", self.right, ctx)
        if left.geometry == "Data" or right.geometry != "Data":
            raise GraphError("features are joined with data rows")
        kinds = left.columns.get(self.left_column), right.columns.get(self.right_column)
        if None in kinds:
            raise GraphError("unknown join column")
        if kinds[0] != kinds[1] or kinds[0] in ("bool", "datetime"):
            raise GraphError(f"columns of types {kinds[0]} and {kinds[1]} can't be joined")
        names = self._names(left, right)
        return left.but(columns={**left.columns, **{names[c]: t for c, t in right.columns.items()}})

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        left, right = need("vector", self.left, ctx), need("vector", self.right, ctx)
        names = self._names(left, right)
        asked = rect.but(columns=None)
        a = self.left.query(ctx, asked).alias("a")
        b = self.right.query(ctx, asked.but(bbox=None)).alias("b")
        key_a, key_b = F.col(f"a.`{self.left_column}`"), F.col(f"b.`{self.right_column}`")
        # the key decides the exchange; times are compared within a key, and a hot key is split by adaptive execution
        on = (key_a == key_b) & intersects(F.col("a.t_start"), F.col("a.t_end"), F.col("b.t_start"), F.col("b.t_end"))
        joined = a.join(b, on).select(
            F.greatest("a.t_start", "b.t_start").alias("t_start"), F.least("a.t_end", "b.t_end").alias("t_end"), F.col("a.geom").alias("geom"),
            *[F.col(f"a.`{c}`").alias(c) for c in left.columns], *[F.col(f"b.`{c}`").alias(n) for c, n in names.items()],
        )
        if rect.columns is not None:
            joined = joined.select("t_start", "t_end", "geom", *[c for c in (*left.columns, *names.values()) if c in rect.columns])
        return joined


#: Parameters of the spatial join: cells along each axis of the polygons' bounds, points of polygons that are broadcast at most (those of a
#: polygon once for each cell that it is dealt to), and polygons and points of theirs that become part of a plain filter at most.
CELLS, BROADCAST_POINTS, FEW_POLYGONS, FEW_POINTS = 64, 2_000_000, 64, 20_000


@dataclass(frozen=True)
class PointInPolygonFilter(Operator):
    """Points of which any lies in any polygon at a time that both share.

    A few polygons are a filter: one pass over the points.  More are dealt to the cells of a grid that their bounds meet, and points to the cell they
    are in, so that the join has an equality key; the ray is cast only within a cell.
    """

    TYPE: ClassVar[str] = "PointInPolygonFilter"
    INPUTS: ClassVar[tuple[str, ...]] = ("points", "polygons")
    points: Operator
    polygons: Operator

    def describe(self, ctx: Context) -> VectorDescriptor:
        points, polygons = need("vector", self.points, ctx), need("vector", self.polygons, ctx)
        if points.geometry != "MultiPoint" or polygons.geometry != "MultiPolygon":
            raise GraphError("points are filtered by polygons")
        if points.srs != polygons.srs:
            raise GraphError(f"{points.srs} is not {polygons.srs}")
        return points

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        from terrafold.sources.tables import identity

        points = self.points.query(ctx, rect)
        points = points.withColumn("__id", identity(points.columns))
        polygons = self.polygons.query(ctx, rect.but(columns=())).select(F.col("t_start").alias("p_start"), F.col("t_end").alias("p_end"), F.explode("geom").alias("polygon"))
        x0, y0, x1, y1 = geometry.bounds(F.array("polygon"), "MultiPolygon")
        polygons = polygons.withColumns({"x0": x0, "y0": y0, "x1": x1, "y1": y1})
        n, vertices, *box = polygons.agg(F.count(F.lit(1)), F.sum(F.size(F.flatten("polygon"))), F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
        if not n:
            return points.drop("__id").limit(0)
        if n <= FEW_POLYGONS and vertices <= FEW_POINTS:
            schema = polygons.schema.simpleString()
            known = F.from_json(F.lit(polygons.select(F.to_json(F.collect_list(F.struct("*")))).first()[0]), f"array<{schema}>")
            near = lambda p, q: p["x"].between(q["x0"], q["x1"]) & p["y"].between(q["y0"], q["y1"])
            hit = lambda p, q: near(p, q) & intersects(F.col("t_start"), F.col("t_end"), q["p_start"], q["p_end"]) & geometry.in_polygons(F.array(q["polygon"]), p["x"], p["y"])
            return points.where(F.exists("geom", lambda p: F.exists(known, lambda q: hit(p, q)))).drop("__id")
        width, height = (max((box[i + 2] - box[i]) / CELLS, 1e-12) for i in (0, 1))
        cell = lambda v, low, size: F.floor((v - low) / size)
        across = lambda a, b, low, size: F.explode(F.sequence(cell(F.col(a), low, size), cell(F.col(b), low, size)))
        dealt = polygons.withColumn("cx", across("x0", "x1", box[0], width)).withColumn("cy", across("y0", "y1", box[1], height))
        # what would be broadcast: each polygon's points once for each of its cells
        span = lambda a, b, low, size: cell(F.col(b), low, size) - cell(F.col(a), low, size) + 1
        copies = polygons.agg(F.sum((F.size(F.flatten("polygon")) + 4) * span("x0", "x1", box[0], width) * span("y0", "y1", box[1], height))).first()[0]
        dealt = F.broadcast(dealt) if copies <= BROADCAST_POINTS else dealt
        spread = points.select("*", F.explode("geom").alias("p")).where(F.col("p.x").between(box[0], box[2]) & F.col("p.y").between(box[1], box[3]))
        spread = spread.withColumns({"px": cell(F.col("p.x"), box[0], width), "py": cell(F.col("p.y"), box[1], height)})
        hit = intersects(F.col("t_start"), F.col("t_end"), F.col("p_start"), F.col("p_end")) & geometry.in_polygons(F.array("polygon"), F.col("p.x"), F.col("p.y"))
        inside = lambda own: own.join(dealt, (F.col("px") == F.col("cx")) & (F.col("py") == F.col("cy")) & hit, "left_semi").drop("p", "px", "py")
        # a feature of one point hits or not; only features of several points can hit more than once
        single = inside(spread.where(F.size("geom") == 1))
        hits = inside(spread.where(F.size("geom") > 1)).select("__id").distinct()
        many = points.where(F.size("geom") > 1).join(hits, "__id", "left_semi").select(points.columns)
        return single.unionByName(many).drop("__id")


@dataclass(frozen=True)
class VectorExpression(Operator):
    """A new float column, or a new geometry, from an expression over at most eight numeric columns and the geometry."""

    TYPE: ClassVar[str] = "VectorExpression"
    INPUTS: ClassVar[tuple[str, ...]] = ("vector",)
    vector: Operator
    expression: str
    input_columns: tuple[str, ...] = ()
    output_column: dict | str = field(default="result", hash=False)
    geometry_column_name: str = "geom"

    def _output(self) -> tuple[str, str]:
        """(geometry or column, its type or name)."""
        if isinstance(self.output_column, dict):
            kind = self.output_column["type"]
            return kind, self.output_column["value"]
        return "column", self.output_column

    def describe(self, ctx: Context) -> VectorDescriptor:
        desc = need("vector", self.vector, ctx)
        if len(self.input_columns) > 8:
            raise GraphError("at most eight columns")
        for c in self.input_columns:
            if desc.columns.get(c) not in NUMERIC:
                raise GraphError(f"column {c!r} is no number")
            if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", c) or c == self.geometry_column_name:
                raise GraphError(f"column {c!r} can't be a variable")
        kind, name = self._output()
        if kind == "geometry":
            return desc.but(geometry=name)
        if name in desc.columns:
            raise GraphError(f"column {name!r} exists")
        return desc.but(columns={**desc.columns, name: "float"})

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        desc = need("vector", self.vector, ctx)
        kind, name = self._output()
        names = {c: expression.Value(F.col(c).cast("double")) for c in self.input_columns}
        if desc.geometry != "Data":
            names[self.geometry_column_name] = expression.Value(F.col("geom"), desc.geometry)
        value = expression.compiled(self.expression, names)
        found = self.vector.query(ctx, rect.but(columns=None))
        if kind == "geometry":
            if value.kind != name:
                raise GraphError(f"the expression gives {value.kind}, not {name}")
            return found.withColumn("geom", value.column).where(F.col("geom").isNotNull())
        if value.kind != "number":
            raise GraphError("the expression gives a geometry")
        found = found.withColumn(name, value.column)
        return found if rect.columns is None else found.select(*[c for c in found.columns if c in ("t_start", "t_end", "geom") or c in rect.columns])


@dataclass(frozen=True)
class Reprojection(Operator):
    """Features or pixels in another reference system: features point by point, pixels by the nearest source pixel.

    Features with a point that the target system can't show are left out; pixels without a source pixel are without data.
    """

    TYPE: ClassVar[str] = "Reprojection"
    KEEPS_TIME: ClassVar[bool] = True
    INPUTS: ClassVar[tuple[str, ...]] = ("source",)
    source: Operator
    target_spatial_reference: str
    derive_out_spec: str = "projectionBounds"

    def describe(self, ctx: Context) -> Any:
        desc = self.source.describe(ctx)
        projection.check(desc.srs, self.target_spatial_reference)
        if desc.kind == "vector":
            return desc.but(srs=self.target_spatial_reference)
        from terrafold.operators.resampling import reprojected

        return reprojected(desc, self.target_spatial_reference, self.derive_out_spec)

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        desc = self.source.describe(ctx)
        if desc.kind == "raster":
            from terrafold.operators.resampling import reproject_pixels

            return reproject_pixels(self, desc, ctx, rect)
        target, box = self.target_spatial_reference, rect.bbox
        if box is not None:
            box = projection.project_box(target, desc.srs, box)
            if box is None:  # no place there: an empty result
                return self.source.query(ctx, rect.but(bbox=None)).where(F.lit(False))
        found = self.source.query(ctx, rect.but(bbox=box))
        found = found.withColumn("geom", geometry.mapped(F.col("geom"), desc.geometry, lambda x, y: projection.project(desc.srs, target, x, y)))
        if projection.GEOS in (target, desc.srs):  # a feature has no geometry there if any of its points has none
            found = found.where(~F.exists(geometry.coordinates(F.col("geom"), desc.geometry), lambda p: p["x"].isNull() | p["y"].isNull()))
        return found


@dataclass(frozen=True)
class LineSimplification(Operator):
    """Lines or polygons with fewer points: douglasPeucker by distance, visvalingam by area."""

    TYPE: ClassVar[str] = "LineSimplification"
    INPUTS: ClassVar[tuple[str, ...]] = ("vector",)
    vector: Operator
    algorithm: str = "douglasPeucker"
    epsilon: float | None = None

    def describe(self, ctx: Context) -> VectorDescriptor:
        desc = need("vector", self.vector, ctx)
        if desc.geometry not in ("MultiLineString", "MultiPolygon"):
            raise GraphError("only lines and polygons are simplified")
        if self.algorithm not in ("douglasPeucker", "visvalingam"):
            raise GraphError(f"unknown algorithm {self.algorithm!r}")
        if self.epsilon is None or self.epsilon <= 0:
            raise GraphError("epsilon must be positive")
        return desc

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        from terrafold.operators.simplify import simplified

        return simplified(self.vector.query(ctx, rect), self.describe(ctx).geometry, self.algorithm, self.epsilon)


#: What collections offer besides operators, on DataFrames.
def sort_by_time(df: DataFrame) -> DataFrame:
    return df.orderBy("t_start", "t_end")


def append(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.unionByName(other)


def replace_time(df: DataFrame, start: Column, end: Column) -> DataFrame:
    return df.withColumns({"t_start": start, "t_end": end})


def time_bounds(df: DataFrame) -> DataFrame:
    """One row: the hull of all intervals."""
    return df.agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"))


ALWAYS = (MIN_MS, MAX_MS)
