"""Closed-form projections as Columns and numbers: EPSG:4326, EPSG:3857, the UTM zones EPSG:32601-32660 and EPSG:32701-32760, and SR-ORG:81.

Every pair goes by way of degrees.  UTM is the transverse Mercator projection of the WGS 84 ellipsoid in Krueger's series up to the
fourth power of the third flattening, exact to less than a millimetre inside a zone.  SR-ORG:81 is the view of a geostationary satellite
over the null meridian: angles of its scan times its height.  Places that it doesn't see, and angles that miss the Earth, have no coordinates:
NULL, and NaN as numbers.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the sphere, and the latitude at which the square map ends.
RADIUS, MAX_LATITUDE = 6_378_137.0, 85.06
AREA = {"EPSG:4326": (-180.0, -90.0, 180.0, 90.0), "EPSG:3857": (-20037508.342789244, -20048966.1040146, 20037508.342789244, 20048966.104014594)}
#: Flattening of the ellipsoid, scale on the central meridian, false easting, and false northing of the south.
FLATTENING, SCALE, EASTING, NORTHING = 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_UTM = re.compile(r"EPSG:32([67])(0[1-9]|[1-5]\d|60)")
#: The geostationary system, the satellite's height, and the end of its square.
GEOS, HEIGHT, GEOS_EDGE = "SR-ORG:81", 35_785_831.0, 5_568_748.276
#: Parameter: steps along an edge of a box whose image is no box.
EDGE_STEPS = 24


class ProjectionError(ValueError):
    """No closed form is known for this pair."""


def zone(srs: str) -> tuple[float, bool] | None:
    """(central meridian, whether it is a southern zone) of a UTM zone."""
    m = _UTM.fullmatch(srs or "")
    return (int(m[2]) * 6 - 183.0, m[1] == "7") if m else None


def check(source: str, target: str) -> None:
    if source != target and any(s not in AREA and s != GEOS and zone(s) is None for s in (source, target)):
        raise ProjectionError(f"no projection from {source} to {target}")


def separable(source: str, target: str) -> bool:
    """Whether x depends on x alone, and y on y alone."""
    return source in AREA and target in AREA


class _Numbers:
    sin, cos, tan, sinh, cosh, atanh, asin, atan, sqrt, atan2 = (staticmethod(f) for f in (math.sin, math.cos, math.tan, math.sinh, math.cosh, math.atanh, math.asin, math.atan, math.sqrt, math.atan2))

    @staticmethod
    def where(condition: bool, make: Callable[[], float]) -> float:
        return make() if condition else math.nan


class _Columns:
    sin, cos, tan, sinh, cosh, atanh, asin, atan, sqrt, atan2 = (staticmethod(f) for f in (F.sin, F.cos, F.tan, F.sinh, F.cosh, F.atanh, F.asin, F.atan, F.sqrt, F.atan2))

    @staticmethod
    def where(condition: Column, make: Callable[[], Column]) -> Column:
        return F.when(condition, make())


@functools.cache
def _series() -> tuple[float, float, tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """Third flattening, radius of the rectifying circle, and the coefficients to the plane, back, and from conformal latitude."""
    n = FLATTENING / (2 - FLATTENING)
    power = lambda *c: sum(v * n**k for k, v in enumerate(c, 1))
    plane = power(1 / 2, -2 / 3, 5 / 16, 41 / 180), power(0, 13 / 48, -3 / 5, 557 / 1440), power(0, 0, 61 / 240, -103 / 140), power(0, 0, 0, 49561 / 161280)
    back = power(1 / 2, -2 / 3, 37 / 96, -1 / 360), power(0, 1 / 48, 1 / 15, -437 / 1440), power(0, 0, 17 / 480, -37 / 840), power(0, 0, 0, 4397 / 161280)
    latitude = power(2, -2 / 3, -2, 116 / 45), power(0, 7 / 3, -8 / 5, -227 / 45), power(0, 0, 56 / 15, -136 / 35), power(0, 0, 0, 4279 / 630)
    return n, RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64), plane, back, latitude


def _to_utm(m: Any, meridian: float, south: bool, lon: Any, lat: Any) -> tuple[Any, Any]:
    """Easting and northing of radians."""
    n, circle, plane, _, _ = _series()
    e = 2 * math.sqrt(n) / (1 + n)
    t = m.sinh(m.atanh(m.sin(lat)) - e * m.atanh(e * m.sin(lat)))
    away = lon - math.radians(meridian)
    up, side = m.atan2(t, m.cos(away)), m.atanh(m.sin(away) / m.sqrt(t * t + 1))
    x, y = side, up
    for j, c in enumerate(plane, 1):
        x = x + c * m.cos(2 * j * up) * m.sinh(2 * j * side)
        y = y + c * m.sin(2 * j * up) * m.cosh(2 * j * side)
    return x * (SCALE * circle) + EASTING, y * (SCALE * circle) + (NORTHING if south else 0.0)


def _from_utm(m: Any, meridian: float, south: bool, x: Any, y: Any) -> tuple[Any, Any]:
    """Radians of easting and northing."""
    _, circle, _, back, latitude = _series()
    up, side = (y - (NORTHING if south else 0.0)) / (SCALE * circle), (x - EASTING) / (SCALE * circle)
    a, b = up, side
    for j, c in enumerate(back, 1):
        a = a - c * m.sin(2 * j * up) * m.cosh(2 * j * side)
        b = b - c * m.cos(2 * j * up) * m.sinh(2 * j * side)
    conformal = m.asin(m.sin(a) / m.cosh(b))
    lat = conformal
    for j, c in enumerate(latitude, 1):
        lat = lat + c * m.sin(2 * j * conformal)
    return m.atan2(m.sinh(b), m.cos(a)) + math.radians(meridian), lat


#: Square of the ratio of the ellipsoid's axes, and the satellite's distance from the Earth's centre.
AXES, ORBIT = (1 - FLATTENING) ** 2, RADIUS + HEIGHT


def _to_geos(m: Any, lon: Any, lat: Any) -> tuple[Any, Any]:
    """Scan angles times height of radians: the satellite lies on the first axis, the null meridian's."""
    geocentric = m.atan(AXES * m.tan(lat))
    away = RADIUS * math.sqrt(AXES) / m.sqrt(1 - (1 - AXES) * m.cos(geocentric) * m.cos(geocentric))
    a, b, c = away * m.cos(geocentric) * m.cos(lon), away * m.cos(geocentric) * m.sin(lon), away * m.sin(geocentric)
    seen = (ORBIT - a) * a - b * b - c * c / AXES >= 0
    return m.where(seen, lambda: HEIGHT * m.atan2(b, ORBIT - a)), m.where(seen, lambda: HEIGHT * m.atan2(c, m.sqrt(b * b + (ORBIT - a) * (ORBIT - a))))


def _from_geos(m: Any, x: Any, y: Any) -> tuple[Any, Any]:
    """Radians where the ray of a scan angle first meets the ellipsoid."""
    side = m.tan(x / HEIGHT)
    up = m.tan(y / HEIGHT) * m.sqrt(1 + side * side)
    squares = 1 + side * side + up * up / AXES  # the ray (-1, side, up) in a space where the ellipsoid is a sphere
    inside = ORBIT**2 - squares * (ORBIT**2 - RADIUS**2)
    reach = lambda: (ORBIT - m.sqrt(inside)) / squares
    lon = lambda: m.atan2(reach() * side, ORBIT - reach())
    lat = lambda: m.atan(reach() * up / AXES / m.sqrt((ORBIT - reach()) * (ORBIT - reach()) + reach() * side * (reach() * side)))
    return m.where(inside >= 0, lon), m.where(inside >= 0, lat)


def project(source: str, target: str, x: Column, y: Column) -> tuple[Column, Column]:
    check(source, target)
    if source == target:
        return x, y
    if own := zone(source):
        x, y = (F.degrees(v) for v in _from_utm(_Columns, *own, x, y))
    elif source == GEOS:
        x, y = (F.degrees(v) for v in _from_geos(_Columns, x, y))
    elif source == "EPSG:3857":
        x, y = F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)
    if own := zone(target):
        return _to_utm(_Columns, *own, F.radians(x), F.radians(y))
    if target == GEOS:
        return _to_geos(_Columns, F.radians(x), F.radians(y))
    if target == "EPSG:3857":
        return F.radians(x) * RADIUS, F.log(F.tan(F.radians(y) / 2 + math.pi / 4)) * RADIUS
    return x, y


def project_number(source: str, target: str, x: float, y: float) -> tuple[float, float]:
    check(source, target)
    if source == target:
        return x, y
    if own := zone(source):
        x, y = (math.degrees(v) for v in _from_utm(_Numbers, *own, x, y))
    elif source == GEOS:
        x, y = (math.degrees(v) for v in _from_geos(_Numbers, x, y))
    elif source == "EPSG:3857":
        x, y = math.degrees(x / RADIUS), math.degrees(2 * math.atan(math.exp(y / RADIUS)) - math.pi / 2)
    if own := zone(target):
        return _to_utm(_Numbers, *own, math.radians(x), math.radians(max(-89.9, min(89.9, y))))
    if target == GEOS:
        return _to_geos(_Numbers, math.radians(x), math.radians(y))
    if target == "EPSG:3857":
        y = max(-MAX_LATITUDE, min(MAX_LATITUDE, y))
        return math.radians(x) * RADIUS, math.log(math.tan(math.radians(y) / 2 + math.pi / 4)) * RADIUS
    return x, y


Box = tuple[float, float, float, float]


def _cut(box: Box, area: Box) -> Box | None:
    low, high = (max(box[0], area[0]), max(box[1], area[1])), (min(box[2], area[2]), min(box[3], area[3]))
    return None if low[0] > high[0] or low[1] > high[1] else (*low, *high)


def _image(source: str, target: str, box: Box) -> Box:
    """The box around the image of a box's edges."""
    if separable(source, target):
        return (*project_number(source, target, *box[:2]), *project_number(source, target, *box[2:]))
    steps = [i / EDGE_STEPS for i in range(EDGE_STEPS + 1)]
    xs, ys = ([box[k] + (box[k + 2] - box[k]) * s for s in steps] for k in (0, 1))
    middle = [0.0] if box[0] <= 0 <= box[2] else []
    edge = [(x, y) for x in xs for y in (box[1], box[3])] + [(x, y) for y in ys for x in (box[0], box[2], *middle)]
    if own := zone(target):  # the meridian in the middle reaches farthest
        edge += [(own[0], y) for y in ys if source == "EPSG:4326" and box[0] <= own[0] <= box[2]]
    made = [project_number(source, target, *p) for p in edge]
    if any(math.isnan(v) for p in made for v in p):  # a part that the satellite doesn't see: all that it sees
        return _image_of_all(target)
    return min(p[0] for p in made), min(p[1] for p in made), max(p[0] for p in made), max(p[1] for p in made)


def _image_of_all(target: str) -> Box:
    if target == GEOS:
        return (-GEOS_EDGE, -GEOS_EDGE, GEOS_EDGE, GEOS_EDGE)
    return degrees_of_use(GEOS) if target == "EPSG:4326" else _image("EPSG:4326", target, _cut(degrees_of_use(GEOS), degrees_of_use(target)) or degrees_of_use(target))


def degrees_of_use(srs: str) -> Box:
    """Where a system is defined, in degrees."""
    if srs == GEOS:  # the horizon: where the ray to the satellite touches the equator, and a little more for the flat pole
        edge = math.degrees(math.acos(RADIUS / ORBIT)) + 0.1
        return (-edge, -edge, edge, edge)
    if own := zone(srs):
        return (own[0] - 3, -80.0, own[0] + 3, 0.0) if own[1] else (own[0] - 3, 0.0, own[0] + 3, 84.0)
    return AREA["EPSG:4326"] if srs == "EPSG:4326" else (-180.0, -MAX_LATITUDE, 180.0, MAX_LATITUDE)


def project_box(source: str, target: str, box: Box) -> Box | None:
    """The box in the target system, or None if it lies outside the area where that is defined."""
    check(source, target)
    if separable(source, target) or source == target:
        own = _cut(box, AREA[source]) if source in AREA else box
        return own and _image(source, target, own)
    own = _image(source, "EPSG:4326", box)
    for srs in (source, target):
        own = own and _cut(own, degrees_of_use(srs))
    return own and _image("EPSG:4326", target, own)
