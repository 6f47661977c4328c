"""Planar geometry on nested arrays of points (struct x, y), as Columns.

MultiPoint: array of points.  MultiLineString: array of lines.  MultiPolygon: array of polygons, each an array of rings, the
outer one first.  Rings are closed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
GEOMETRY_TYPES = {"MultiPoint": f"array<{POINT}>", "MultiLineString": f"array<array<{POINT}>>", "MultiPolygon": f"array<array<array<{POINT}>>>"}


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def multi_point(x: Column, y: Column) -> Column:
    """A MultiPoint of one point."""
    return F.array(point(x, y))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _edges(ring: Column, value) -> Column:  # noqa: ANN001
    """Sum of value(a, b) over neighbouring points."""
    return total(F.transform(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, i: value(a, F.get(ring, i + 1))))


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def polygons_area(geom: Column) -> Column:
    """Area without holes of a MultiPolygon."""
    ring = lambda r: F.abs(_edges(r, _cross)) / 2
    return total(F.transform(geom, lambda p: 2 * ring(p[0]) - total(F.transform(p, ring))))


def area(geom: Column, kind: str) -> Column:
    """Unsigned planar area; points and lines have none."""
    return polygons_area(geom) if kind == "MultiPolygon" else F.when(geom.isNotNull(), F.lit(0.0))


def centroid(geom: Column, kind: str) -> Column:
    """A MultiPoint of one point: of points the mean, of lines by length, of polygons by area."""
    if kind == "MultiPoint":
        n = F.size(geom)
        return F.when(n > 0, multi_point(total(F.transform(geom, lambda p: p["x"])) / n, total(F.transform(geom, lambda p: p["y"])) / n))
    if kind == "MultiLineString":
        length = lambda a, b: F.sqrt((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2)
        whole = total(F.transform(geom, lambda line: _edges(line, length)))
        mean = lambda k: total(F.transform(geom, lambda line: _edges(line, lambda a, b: length(a, b) * (a[k] + b[k]) / 2)))
        return F.when(whole > 0, multi_point(mean("x") / whole, mean("y") / whole))
    # moments of a ring are signed by its direction: holes count against the outer ring whatever theirs is
    signed = lambda r: _edges(r, _cross)
    sign = lambda r: F.when(signed(r) >= 0, 1.0).otherwise(-1.0)
    moment = lambda r, k: _edges(r, lambda a, b: (a[k] + b[k]) * _cross(a, b)) * sign(r)
    poly = lambda k: total(F.transform(geom, lambda p: 2 * moment(p[0], k) - total(F.transform(p, lambda r: moment(r, k)))))
    six = 6 * polygons_area(geom)
    return F.when(six > 0, multi_point(poly("x") / six, poly("y") / six))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; what holds on the boundary is not specified."""

    def crosses(a: Column, b: Column) -> Column:
        level = (a["y"] > y) != (b["y"] > y)
        run = F.when(level, (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
        return F.when(level & (x < run), 1.0).otherwise(0.0)

    return _edges(ring, crosses) % 2 == 1


def in_polygons(geom: Column, x: Column, y: Column) -> Column:
    """Inside an outer ring and in none of its holes."""
    return F.exists(geom, lambda p: in_ring(p[0], x, y) & ~F.exists(F.slice(p, 2, F.size(p)), lambda h: in_ring(h, x, y)))


def coordinates(geom: Column, kind: str) -> Column:
    """All points of a geometry."""
    return {"MultiPoint": geom, "MultiLineString": F.flatten(geom), "MultiPolygon": F.flatten(F.flatten(geom))}[kind]


def bounds(geom: Column, kind: str) -> tuple[Column, Column, Column, Column]:
    """x_min, y_min, x_max, y_max."""
    at = coordinates(geom, kind)
    xs, ys = F.transform(at, lambda p: p["x"]), F.transform(at, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def mapped(geom: Column, kind: str, change) -> Column:  # noqa: ANN001
    """A geometry whose points are changed by change(x, y) -> (x, y)."""
    one = lambda p: point(*change(p["x"], p["y"]))
    if kind == "MultiPoint":
        return F.transform(geom, one)
    if kind == "MultiLineString":
        return F.transform(geom, lambda line: F.transform(line, one))
    return F.transform(geom, lambda p: F.transform(p, lambda r: F.transform(r, one)))


def overlaps_box(geom: Column, kind: str, box: tuple[float, float, float, float]) -> Column:
    """Whether the bounds of a geometry meet a box."""
    x0, y0, x1, y1 = bounds(geom, kind)
    return (x0 <= box[2]) & (x1 >= box[0]) & (y0 <= box[3]) & (y1 >= box[1])
