"""Pixels on other grids.

A target pixel samples the source at one point.  With ratio r source pixels for a target pixel, target t samples at t * r + shift; so
the targets of a source pixel s are a run of numbers, and each pixel makes its targets without any join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.engine.graph import Context, GraphError, Operator, need
from terrafold.functions import projection
from terrafold.functions.casts import machine_cast
from terrafold.model.descriptor import GeoTransform, RasterDescriptor
from terrafold.model.rect import Rect

EPS = 1e-9


def resolution(spec: dict, t: GeoTransform, finer: bool) -> tuple[float, float]:
    """(x, y) pixel sizes: {"type": "resolution", "x", "y"} or {"type": "fraction", "x", "y"}."""
    if spec["type"] == "resolution":
        return float(spec["x"]), float(spec["y"])
    if min(spec["x"], spec["y"]) < 1:
        raise GraphError("a fraction is at least 1")
    return tuple(abs(s) / f if finer else abs(s) * f for s, f in ((t.x_size, spec["x"]), (t.y_size, spec["y"])))


def regridded(desc: RasterDescriptor, x: float, y: float) -> RasterDescriptor:
    """The same origin and about the same bounds with other pixel sizes."""
    t = desc.transform
    rx, ry = x / abs(t.x_size), y / abs(t.y_size)
    a, b, c, d = desc.pixels
    new = GeoTransform(t.x, t.y, math.copysign(x, t.x_size), math.copysign(y, t.y_size))
    low, high = (lambda v, r: math.floor(v / r + EPS)), (lambda v, r: math.ceil((v + 1) / r - EPS) - 1)
    return desc.but(transform=new, pixels=(low(a, ry), high(b, ry), low(c, rx), high(d, rx)))


def source_pixels(pixels: tuple[int, int, int, int] | None, ry: float, rx: float) -> tuple[int, int, int, int] | None:
    """Source pixels that a run of targets can sample, with one more at the end."""
    if pixels is None:
        return None
    a, b, c, d = pixels
    return math.floor(a * ry), math.ceil((b + 1) * ry), math.floor(c * rx), math.ceil((d + 1) * rx)


def targets(s: Column, r: float, shift: float) -> Column:
    """All t with floor(t * r + shift) = s."""
    first = F.ceil((s - shift) / r - EPS)
    last = F.ceil((s + 1 - shift) / r - EPS) - 1
    return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int")))


def nearest(df: DataFrame, ry: float, rx: float) -> DataFrame:
    """Each target takes the source pixel under its centre."""
    wide = df.withColumns({"ty": targets(F.col("y"), ry, 0.5 * ry), "tx": targets(F.col("x"), rx, 0.5 * rx)})
    return wide.withColumn("y", F.explode("ty")).withColumn("x", F.explode("tx")).drop("ty", "tx")


@dataclass(frozen=True)
class Interpolation(Operator):
    """A finer grid: nearestNeighbor samples at the centre of a target pixel, biLinear at its upper left, where it needs all four neighbours."""

    TYPE: ClassVar[str] = "Interpolation"
    KEEPS_TIME: ClassVar[bool] = True
    INPUTS: ClassVar[tuple[str, ...]] = ("raster",)
    raster: Operator
    interpolation: str = "nearestNeighbor"
    output_resolution: dict = field(default_factory=dict, hash=False)

    def describe(self, ctx: Context) -> RasterDescriptor:
        desc = need("raster", self.raster, ctx)
        if self.interpolation not in ("nearestNeighbor", "biLinear"):
            raise GraphError(f"unknown interpolation {self.interpolation!r}")
        x, y = resolution(self.output_resolution, desc.transform, finer=True)
        if x > abs(desc.transform.x_size) + EPS or y > abs(desc.transform.y_size) + EPS:
            raise GraphError("the output must not be coarser")
        return regridded(desc, x, y)

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        source, desc = need("raster", self.raster, ctx), self.describe(ctx)
        ry, rx = desc.transform.y_size / source.transform.y_size, desc.transform.x_size / source.transform.x_size
        rect = rect.on_grid(desc.transform)
        found = self.raster.query(ctx, rect.but(bbox=None, pixels=source_pixels(rect.pixels, ry, rx)))
        if self.interpolation == "nearestNeighbor":
            return rect.of_pixels(nearest(found, ry, rx))
        row = Window.partitionBy("t_start", "t_end", "band", "y").orderBy("x")
        col = Window.partitionBy("t_start", "t_end", "band", "x").orderBy("y")
        v = found.withColumn("a", F.col("value").cast("double"))
        v = v.withColumns({"b": F.when(F.lead("x").over(row) == F.col("x") + 1, F.lead("a").over(row))})
        below = lambda c: F.when(F.lead("y").over(col) == F.col("y") + 1, F.lead(c).over(col))
        v = v.withColumns({"c": below("a"), "d": below("b"), "ty": targets(F.col("y"), ry, 0.0), "tx": targets(F.col("x"), rx, 0.0), "sy": F.col("y"), "sx": F.col("x")})
        v = v.withColumn("y", F.explode("ty")).withColumn("x", F.explode("tx"))
        fy, fx = F.col("y") * ry - F.col("sy"), F.col("x") * rx - F.col("sx")
        value = (F.col("a") * (1 - fx) + F.col("b") * fx) * (1 - fy) + (F.col("c") * (1 - fx) + F.col("d") * fx) * fy
        out = v.select("t_start", "t_end", "band", "y", "x", machine_cast(value, "F64", desc.data_type).alias("value"))
        return rect.of_pixels(out)


@dataclass(frozen=True)
class Downsampling(Operator):
    """A coarser grid: each target takes the source pixel under its centre."""

    TYPE: ClassVar[str] = "Downsampling"
    KEEPS_TIME: ClassVar[bool] = True
    INPUTS: ClassVar[tuple[str, ...]] = ("raster",)
    raster: Operator
    sampling_method: str = "nearestNeighbor"
    output_resolution: dict = field(default_factory=dict, hash=False)

    def describe(self, ctx: Context) -> RasterDescriptor:
        desc = need("raster", self.raster, ctx)
        if self.sampling_method != "nearestNeighbor":
            raise GraphError(f"unknown method {self.sampling_method!r}")
        x, y = resolution(self.output_resolution, desc.transform, finer=False)
        if x < abs(desc.transform.x_size) - EPS or y < abs(desc.transform.y_size) - EPS:
            raise GraphError("the output must not be finer")
        return regridded(desc, x, y)

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        source, desc = need("raster", self.raster, ctx), self.describe(ctx)
        ry, rx = desc.transform.y_size / source.transform.y_size, desc.transform.x_size / source.transform.x_size
        rect = rect.on_grid(desc.transform)
        found = self.raster.query(ctx, rect.but(bbox=None, pixels=source_pixels(rect.pixels, ry, rx)))
        return rect.of_pixels(nearest(found, ry, rx))


def reprojected(desc: RasterDescriptor, target: str, derive: str = "projectionBounds") -> RasterDescriptor:
    """The descriptor in another system: as many pixels along each axis over the projected bounds."""
    t, (a, b, c, d) = desc.transform, desc.pixels
    xs, ys = sorted([t.x + c * t.x_size, t.x + (d + 1) * t.x_size]), sorted([t.y + a * t.y_size, t.y + (b + 1) * t.y_size])
    box = projection.project_box(desc.srs, target, (xs[0], ys[0], xs[1], ys[1]))
    if box is None:
        raise GraphError(f"nothing to show in {target}")
    rows, cols = b - a + 1, d - c + 1
    new = GeoTransform(box[0], box[3], (box[2] - box[0]) / cols, -(box[3] - box[1]) / rows)
    return desc.but(srs=target, transform=new, pixels=(0, rows - 1, 0, cols - 1))


def reproject_pixels(node: Any, source: RasterDescriptor, ctx: Context, rect: Rect) -> DataFrame:
    """Target pixels take the source pixel under their centre, and are without data where there is none.

    Where rows and columns project apart from each other, two lists of numbers, as long as the grid's sides, map all pixels.  Else the
    target grid is made as rows, whose centres are projected by Columns, and joined with the source by row and column.
    """
    from terrafold.sources.tables import dense

    desc = node.describe(ctx)
    rect = rect.on_grid(desc.transform)
    a, b, c, d = grid = rect.pixels or desc.pixels
    t, s, own = desc.transform, source.transform, source.pixels
    simple = projection.separable(desc.srs, source.srs)
    if simple:
        rows = [(y, _row(desc, source, y)) for y in range(a, b + 1)]
        cols = [(x, _column(desc, source, x)) for x in range(c, d + 1)]
        ys, xs = [k for _, k in rows if k is not None and own[0] <= k <= own[1]], [k for _, k in cols if k is not None and own[2] <= k <= own[3]]
        inner = (min(ys), max(ys), min(xs), max(xs)) if ys and xs else None
        whole = len(ys) == len(rows) and len(xs) == len(cols)
    else:
        corners = [t.x + c * t.x_size, t.y + a * t.y_size, t.x + (d + 1) * t.x_size, t.y + (b + 1) * t.y_size]
        box = projection.project_box(desc.srs, source.srs, (min(corners[::2]), min(corners[1::2]), max(corners[::2]), max(corners[1::2])))
        near = Rect(bbox=box).on_grid(s).grown(1, 1).pixels if box else (0, -1, 0, -1)
        inner = (max(near[0], own[0]), min(near[1], own[1]), max(near[2], own[2]), min(near[3], own[3]))
        inner = inner if inner[0] <= inner[1] and inner[2] <= inner[3] else None
        whole = False
    found = node.source.query(ctx, rect.but(bbox=None, pixels=inner))
    found = found if inner else found.where(F.lit(False))
    covered = F.col("sy").between(*inner[:2]) & F.col("sx").between(*inner[2:]) if inner else F.lit(False)
    names = ["t_start", "t_end", "band", F.col("ty").alias("y"), F.col("tx").alias("x"), "value"]
    if simple:  # a row for each row or column of the grid
        ys, xs = ctx.spark.createDataFrame(rows, "ty int, sy int"), ctx.spark.createDataFrame(cols, "tx int, sx int")
        under = lambda df, y, x: df.join(F.broadcast(ys), F.col(y) == F.col("ty")).join(F.broadcast(xs), F.col(x) == F.col("tx"))
        out = found.join(F.broadcast(ys), F.col("y") == F.col("sy")).join(F.broadcast(xs), F.col("x") == F.col("sx")).select(*names)
    else:
        under = lambda df, y, x: _under(df, desc, source, y, x)
        places = ctx.spark.range(a, b + 1).select(F.col("id").cast("int").alias("ty"), F.explode(F.sequence(F.lit(c), F.lit(d))).alias("tx"))
        places = under(places, "ty", "tx").where(covered).select("ty", "tx", F.col("sy").alias("y"), F.col("sx").alias("x"))
        out = found.join(places, ["y", "x"]).select(*names)
    if whole:
        return out
    times = node.source.times(ctx, rect)
    slices = node.source.query(ctx, rect.but(bbox=None, pixels=None)).select("t_start", "t_end").distinct() if times is None else ctx.spark.createDataFrame(times, "t_start long, t_end long")
    empty = Rect(bands=rect.bands).of_pixels(dense(ctx, slices, grid, len(source.bands)))
    missing = under(empty, "y", "x").where(~F.coalesce(covered, F.lit(False)))
    return out.unionByName(missing.select("t_start", "t_end", "band", "y", "x", F.lit(None).cast(found.schema["value"].dataType).alias("value")))


def _row(desc: RasterDescriptor, source: RasterDescriptor, y: int) -> int | None:
    """The source row under a target row, None beyond the area where the source system is defined."""
    own = desc.transform.centre(y, 0)[1]
    there = projection.project_number(desc.srs, source.srs, 0.0, own)[1]
    back = projection.project_number(source.srs, desc.srs, 0.0, there)[1]
    return source.transform.pixel(0.0, there)[0] if math.isclose(back, own, rel_tol=1e-9, abs_tol=1e-6) else None


def _column(desc: RasterDescriptor, source: RasterDescriptor, x: int) -> int | None:
    return source.transform.pixel(projection.project_number(desc.srs, source.srs, desc.transform.centre(0, x)[0], 0.0)[0], 0.0)[1]


def _under(df: DataFrame, desc: RasterDescriptor, source: RasterDescriptor, y: str, x: str) -> DataFrame:
    """With the row ``sy`` and the column ``sx`` of the source pixel under the centre of a target pixel; NULL if that has no place there."""
    t, s = desc.transform, source.transform
    px, py = projection.project(desc.srs, source.srs, t.x + (F.col(x) + 0.5) * t.x_size, t.y + (F.col(y) + 0.5) * t.y_size)
    index = lambda v: F.when(~F.isnan(v), F.floor(v).try_cast("int"))
    return df.withColumns({"sy": index((py - s.y) / s.y_size), "sx": index((px - s.x) / s.x_size)})
