"""Every operator as a query over the test tables, with the same result as SQL.

A query is a graph in JSON form and a rectangle; results are brought to longs, doubles and strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import terrafold.operators.clustering
import terrafold.operators.cross
import terrafold.operators.meteosat
import terrafold.operators.ml
import terrafold.operators.raster
import terrafold.operators.resampling
import terrafold.operators.vector
import terrafold.plots.terminal
import terrafold.sources.tables  # noqa: F401
from terrafold.engine.graph import Context, from_json
from terrafold.engine.workers import shared_path
from terrafold.model.rect import Rect
from terrafold.model.time import MAX_MS, MIN_MS
from terrafold.operators.ml import Model, linear, onnx_linear
from terrafold.sinks.outputs import geojson
from terrafold.sources.bindings import BOOKINGS_SQL, DAY, PIXELS_SQL, POINTS_SQL, SPARSE_SQL, T0, context
from terrafold.sources.features import read_geojson

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def canonical(df: DataFrame) -> DataFrame:
    """Integers as longs, floats as doubles; a geometry of one point as x and y."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == "geom":
            out += [c[0]["x"].alias("px"), c[0]["y"].alias("py")]
        elif isinstance(f.dataType, (T.IntegralType, T.DecimalType)):
            out.append(c.cast("long").alias(f.name))
        elif isinstance(f.dataType, T.FractionalType):
            out.append(c.cast("double").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def run(graph: dict, rect: Rect | None = None, finish: Callable[[DataFrame], DataFrame] | None = None, prepare: Callable[[Context], Any] | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx = context(spark, sf_dir)
        if prepare:
            prepare(ctx)
        node = from_json(graph)
        node.describe(ctx)
        df = node.query(ctx, rect or Rect())
        return canonical(finish(df) if finish else df)

    return query


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def op(kind: str, sources: dict | None = None, /, **params: Any) -> dict:
    return {"type": kind, "params": params} | ({"sources": sources} if sources else {})


def over(kind: str, source: dict, key: str = "raster", /, **params: Any) -> dict:
    return op(kind, {key: source}, **params)


POINTS, RASTER = op("MockDatasetDataSource", data="points"), op("GdalSource", data="raster")
ONE = over("BandFilter", RASTER, bands=["a"])
COLS = "event_id, user_id, event_type, maybe, value"
V = f"t_start, t_end, px, py, {COLS}"
R = "t_start, t_end, band, y, x"
with_points = lambda body: f"WITH {POINTS_SQL} {body}"
with_pixels = lambda body: f"WITH {PIXELS_SQL} {body}"
both = lambda body: f"WITH {POINTS_SQL}, {PIXELS_SQL} {body}"
rounded = lambda *names: lambda df: df.withColumns({n: F.round(n, 6) for n in names})
WEEK = (T0 + 3 * DAY, T0 + 10 * DAY)
in_week = f"((t_start >= {WEEK[0]} AND t_start < {WEEK[1]}) OR ({WEEK[0]} >= t_start AND {WEEK[0]} < t_end))"


# ---- sources ----
def csv_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' places, written as CSV and read by the source."""
    folder = shared_path(spark, ".csv")
    c = context(spark, sf_dir).dataset("customers")[0]
    c.select((F.col("c_custkey") % 36 * 10 - 175).alias("x"), (85 - F.col("c_custkey") % 18 * 10).alias("y"), "c_name").write.csv(folder, header=True, sep=";")
    node = from_json(op("CsvSource", filePath=folder, fieldSeparator=";"))
    return canonical(node.query(context(spark, sf_dir), Rect(bbox=(-60.0, -50.0, 60.0, 50.0))))


add("csv_points_bbox", csv_points, f"""SELECT {MIN_MS} AS t_start, {MAX_MS} AS t_end, cast(x AS DOUBLE) AS px, cast(y AS DOUBLE) AS py
 FROM (SELECT c_custkey % 36 * 10 - 175 AS x, 85 - c_custkey % 18 * 10 AS y FROM customer) WHERE x BETWEEN -60 AND 60 AND y BETWEEN -50 AND 50""")

def geojson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points, written as lines of GeoJSON and read by the source."""
    folder = shared_path(spark, ".geojson")
    ctx = context(spark, sf_dir)
    geojson(ctx.dataset("points")[0], "MultiPoint").write.text(folder)
    ctx.datasets["file"] = (read_geojson(spark, [folder], "MultiPoint", ("event_id", "user_id", "event_type", "maybe", "value"), lines=True), None)
    columns = {"geometry": {"type": "MultiPoint"}, "int": ["event_id", "user_id", "maybe"], "text": ["event_type"], "float": ["value"]}
    node = from_json(op("OgrSource", data="file", columns=columns, time={"kind": "startEnd", "start": "when_start", "end": "when_end"}))
    return canonical(node.query(ctx, Rect()))


add("ogr_geojson", geojson_points, with_points(f"SELECT {V} FROM pts"))

EVENT_COLUMNS = {"x": "user_id", "y": "event_id", "int": ["event_id", "user_id"], "float": ["value"], "text": ["event_type"]}
flat = lambda df: df.drop("geom")
add(
    "ogr_attribute_filter",
    run(op("OgrSource", data="events", columns=EVENT_COLUMNS, attributeFilters=[{"attribute": "user_id", "ranges": [[3, 20], [50, 60]], "keepNulls": False}]), finish=flat),
    f"SELECT {MIN_MS} AS t_start, {MAX_MS} AS t_end, event_id, user_id, value, event_type FROM events WHERE user_id BETWEEN 3 AND 20 OR user_id BETWEEN 50 AND 60",
)
add(
    "ogr_projection_rename",
    run(op("OgrSource", data="events", columns=EVENT_COLUMNS | {"rename": {"user_id": "uid"}}, attributeProjection=["uid", "event_type"]), finish=flat),
    f"SELECT {MIN_MS} AS t_start, {MAX_MS} AS t_end, user_id AS uid, event_type FROM events",
)
add(
    "ogr_attribute_query",
    run(op("OgrSource", data="events", columns=EVENT_COLUMNS, attributeQuery="user_id % 5 = 1 AND value > 3"), finish=flat),
    f"SELECT {MIN_MS} AS t_start, {MAX_MS} AS t_end, event_id, user_id, value, event_type FROM events WHERE user_id % 5 = 1 AND value > 3",
)
add(
    "ogr_try_cast_ignore",
    run(op("OgrSource", data="events", columns={"int": ["event_id"], "float": ["event_type"], "rename": {"event_type": "number"}})),
    f"SELECT {MIN_MS} AS t_start, {MAX_MS} AS t_end, event_id, try_cast(event_type AS DOUBLE) AS number FROM events WHERE event_type IS NULL OR try_cast(event_type AS DOUBLE) IS NOT NULL",
)
TIMED = EVENT_COLUMNS | {"float": [], "text": []}
add("time_start_duration", run(op("OgrSource", data="events", columns=TIMED, time={"kind": "start", "start": "ms", "format": "milliseconds", "duration": 7200000}), finish=flat), "SELECT epoch_us(ts) // 1000 AS t_start, epoch_us(ts) // 1000 + 7200000 AS t_end, event_id, user_id FROM events")
add("time_start_infinite", run(op("OgrSource", data="events", columns=TIMED, time={"kind": "start", "start": "ms", "format": "milliseconds", "duration": "infinite"}), finish=flat), f"SELECT epoch_us(ts) // 1000 AS t_start, {MAX_MS} AS t_end, event_id, user_id FROM events")
add("time_start_duration_field", run(op("OgrSource", data="events", columns=TIMED, time={"kind": "startDuration", "start": "ms", "format": "milliseconds", "duration": "user_id"}), finish=flat), "SELECT epoch_us(ts) // 1000 AS t_start, epoch_us(ts) // 1000 + user_id AS t_end, event_id, user_id FROM events")
add(
    "query_rectangle_filter",
    run(POINTS, Rect(bbox=(-100.0, -40.0, 95.0, 45.0), time=WEEK)),
    with_points(f"SELECT {V} FROM pts WHERE px BETWEEN -100 AND 95 AND py BETWEEN -40 AND 45 AND {in_week}"),
)
add("gdal_source_window", run(RASTER, Rect(pixels=(1, 4, 3, 9), time=WEEK, bands=(0, 2))), with_pixels(f"SELECT {R}, value FROM r WHERE y BETWEEN 1 AND 4 AND x BETWEEN 3 AND 9 AND band IN (0, 2) AND {in_week}"))
add("gdal_source_overview", run(op("GdalSource", data="raster", overviewLevel=2)), with_pixels("SELECT t_start, t_end, band, y // 2 AS y, x // 2 AS x, value FROM r WHERE y % 2 = 0 AND x % 2 = 0"))
GAP = (T0 - 2 * DAY, T0 + 2 * DAY)
add(
    "gdal_source_gap_fill",
    run(op("GdalSource", data="raster", fillGaps=True), Rect(time=GAP, bands=(1,))),
    with_pixels(f"""SELECT {R}, value FROM r WHERE band = 1 AND t_start < {GAP[1]} AND t_end > {GAP[0]} UNION ALL
 SELECT {T0} + d.range * {DAY}, {T0} + (d.range + 1) * {DAY}, 1::BIGINT, i.range, j.range, NULL::BIGINT FROM range(-2, 2) AS d, range(8) AS i, range(16) AS j WHERE {T0} + d.range * {DAY} NOT IN (SELECT t_start FROM r)"""),
)
add(
    "multi_band_mosaic",
    run(op("MultiBandGdalSource", data="mosaic")),
    f"""SELECT {T0} AS t_start, {T0 + DAY} AS t_end, 0::BIGINT AS band, l_suppkey % 8 AS y, l_partkey % 16 AS x,
 arg_max(cast(floor(l_quantity) AS BIGINT), l_linenumber * 10000000000 + l_orderkey) FILTER (WHERE l_partkey % 5 <> 0) AS value FROM lineitem GROUP BY ALL""",
)
add("mock_points", run(op("MockPointSource", points=[[1.5, 2.0], [-3.0, 4.25], [100.0, 80.0]]), Rect(bbox=(-10.0, -10.0, 10.0, 10.0))), f"SELECT * FROM (VALUES ({MIN_MS}, {MAX_MS}, 1.5::DOUBLE, 2.0::DOUBLE), ({MIN_MS}, {MAX_MS}, -3.0, 4.25)) AS v(t_start, t_end, px, py)")

# ---- column range filter ----
for name, column, ranges, nulls, where in (
    ("int", "user_id", [[10, 30]], False, "user_id BETWEEN 10 AND 30"),
    ("float", "value", [[5.0, 25.5]], False, "value BETWEEN 5 AND 25.5"),
    ("text", "event_type", [["c", "p"]], False, "event_type BETWEEN 'c' AND 'p'"),
    ("keep_nulls", "maybe", [[10, 30]], True, "maybe BETWEEN 10 AND 30 OR maybe IS NULL"),
    ("multi_range", "user_id", [[1, 4], [40, 41], [90, 120]], False, "user_id BETWEEN 1 AND 4 OR user_id BETWEEN 40 AND 41 OR user_id BETWEEN 90 AND 120"),
):
    add(f"column_range_filter_{name}", run(over("ColumnRangeFilter", POINTS, "vector", column=column, ranges=ranges, keepNulls=nulls)), with_points(f"SELECT {V} FROM pts WHERE {where}"))

# ---- time ----
SNAP = {
    "day": ({"granularity": "days", "step": 2}, f"floor(({{t}}) / {2 * DAY}) * {2 * DAY}", f"{{s}} + {2 * DAY}"),
    "month": ({"granularity": "months", "step": 1}, "epoch_ms(date_trunc('month', make_timestamp({t} * 1000)))", "epoch_ms(make_timestamp({s} * 1000) + INTERVAL 1 MONTH)"),
    "year_ref": ({"granularity": "years", "step": 1}, "epoch_ms(date_trunc('year', make_timestamp({t} * 1000)))", "epoch_ms(make_timestamp({s} * 1000) + INTERVAL 1 YEAR)"),
}
for name, (step, snap, up) in SNAP.items():
    s, e = snap.format(t="t_start"), snap.format(t="t_end")
    add(
        f"time_projection_{name}",
        run(over("TimeProjection", POINTS, "vector", step=step, **({"stepReference": "2010-01-01T00:00:00Z"} if name == "year_ref" else {}))),
        with_points(f"SELECT cast({s} AS BIGINT) AS t_start, cast(CASE WHEN {e} = t_end THEN t_end ELSE {up.format(s=f'cast({e} AS BIGINT)')} END AS BIGINT) AS t_end, px, py, {COLS} FROM pts"),
    )
shifted = lambda days: f"((t_start + {-days * DAY} >= {WEEK[0]} AND t_start + {-days * DAY} < {WEEK[1]}) OR ({WEEK[0]} >= t_start + {-days * DAY} AND {WEEK[0]} < t_end + {-days * DAY}))"
for name, days in (("fwd", 5), ("back", -2)):
    add(
        f"time_shift_relative_{name}",
        run(over("TimeShift", POINTS, "source", kind="relative", granularity="days", value=days), Rect(time=WEEK)),
        with_points(f"SELECT t_start - {days * DAY} AS t_start, t_end - {days * DAY} AS t_end, px, py, {COLS} FROM pts WHERE {shifted(days)}"),
    )
add(
    "time_shift_absolute",
    run(over("TimeShift", RASTER, "source", kind="absolute", timeInterval=[T0 + 5 * DAY, T0 + 7 * DAY]), Rect(time=(T0, T0 + 2 * DAY))),
    with_pixels(f"SELECT t_start - {5 * DAY} AS t_start, t_end - {5 * DAY} AS t_end, band, y, x, value FROM r WHERE t_start >= {T0 + 5 * DAY} AND t_start < {T0 + 7 * DAY}"),
)
add(
    "time_shift_months_raster",
    run(over("TimeShift", ONE, "source", kind="relative", granularity="months", value=-1), Rect(time=(T0 + 31 * DAY, T0 + 34 * DAY))),
    with_pixels(f"SELECT t_start + {31 * DAY} AS t_start, t_end + {31 * DAY} AS t_end, band, y, x, value FROM r WHERE band = 0 AND t_start >= {T0} AND t_start < {T0 + 3 * DAY}"),
)

# ---- vector joins ----
BOOKINGS = op("MockDatasetDataSource", data="bookings")
overlap = "((p.t_start >= b.t_start AND p.t_start < b.t_end) OR (b.t_start >= p.t_start AND b.t_start < p.t_end))"
for name, extra in (("vector_join_equi_time", {}), ("vector_join_suffix", {"rightColumnSuffix": "_order"})):
    add(
        name,
        run(op("VectorJoin", {"left": POINTS, "right": BOOKINGS}, leftColumn="user_id", rightColumn="user_id", **extra)),
        f"""WITH {POINTS_SQL}, {BOOKINGS_SQL} SELECT greatest(p.t_start, b.t_start) AS t_start, least(p.t_end, b.t_end) AS t_end, px, py, event_id, p.user_id, event_type, maybe, value,
 b.user_id AS user_id{extra.get('rightColumnSuffix', 'right')}, o_orderkey, o_orderstatus FROM pts AS p JOIN bookings AS b ON p.user_id = b.user_id AND {overlap}""",
    )
RING = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
AREAS = {
    "rect": ([[MIN_MS, MAX_MS, [[RING(-62, -42, 58, 43)]]], [MIN_MS, MAX_MS, [[RING(99, 1, 121, 22)], [RING(131, -80, 160, -60)]]]], "px BETWEEN -62 AND 58 AND py BETWEEN -42 AND 43 OR px BETWEEN 99 AND 121 AND py BETWEEN 1 AND 22 OR px BETWEEN 131 AND 160 AND py BETWEEN -80 AND -60"),
    "hole": ([[MIN_MS, MAX_MS, [[RING(-62, -42, 58, 43), RING(-22, -12, 18, 13)]]]], "px BETWEEN -62 AND 58 AND py BETWEEN -42 AND 43 AND NOT (px BETWEEN -22 AND 18 AND py BETWEEN -12 AND 13)"),
    "time": ([[*WEEK, [[RING(-62, -42, 58, 43)]]], [T0 + 20 * DAY, T0 + 21 * DAY, [[[[-171, -1], [1, -1], [-171, 81], [-171, -1]]]]]], f"px BETWEEN -62 AND 58 AND py BETWEEN -42 AND 43 AND {in_week} OR t_start < {T0 + 21 * DAY} AND t_end > {T0 + 20 * DAY} AND px > -171 AND py > -1 AND (px + 171) / 172 + (py + 1) / 82 < 1"),
}
for name, (rows, where) in AREAS.items():
    add(f"point_in_polygon_{name}", run(op("PointInPolygonFilter", {"points": POINTS, "polygons": op("MockFeatureCollectionSource", geometryType="MultiPolygon", rows=rows)})), with_points(f"SELECT {V} FROM pts WHERE {where}"))

# ---- expressions ----
for name, text, columns, sql in (
    ("arith", "(user_id + value * 2) / 4 - 3 ** 2", ["user_id", "value"], "(user_id + value * 2) / 4 - 9"),
    ("branch", "if user_id < 20 && value >= 3 { value } else if user_id == 50 || maybe IS NODATA { -1 } else { max(user_id, value) }", ["user_id", "value", "maybe"], "CASE WHEN user_id < 20 AND value >= 3 THEN value WHEN user_id = 50 OR maybe IS NULL THEN -1 ELSE greatest(user_id, value) END"),
    ("let", "let a = user_id * 2; let b = a - value; b * b + mod(a, 7)", ["user_id", "value"], "(user_id * 2 - value) * (user_id * 2 - value) + (user_id * 2) % 7"),
    ("functions", "floor(user_id / 3) + ceil(value / 7) + round(user_id / 4) + abs(value - 20) + min(user_id, 9)", ["user_id", "value"], "floor(user_id / 3) + ceil(value / 7) + round(user_id / 4) + abs(value - 20) + least(user_id, 9)"),
    ("nodata", "maybe + 1", ["maybe"], "maybe + 1"),
    ("trigonometry", "round((sin(value) + cos(value) * tan(value / 50) + atan(value) + tanh(value / 9) + asin(1 / (value + 2)) + acos(1 / (value + 2))) * 1000000) / 1000000", ["value"], "round((sin(value) + cos(value) * tan(value / 50) + atan(value) + (exp(2 * value / 9) - 1) / (exp(2 * value / 9) + 1) + asin(1 / (value + 2)) + acos(1 / (value + 2))) * 1000000) / 1000000"),
    ("logarithms", "round((sqrt(user_id) + ln(user_id + 1) + log10(user_id + 1) + pow(1.5, user_id / 40) + to_degrees(to_radians(user_id)) + pi() + e()) * 1000000) / 1000000", ["user_id"], "round((sqrt(user_id) + ln(user_id + 1) + log10(user_id + 1) + pow(1.5, user_id / 40) + user_id + pi() + exp(1)) * 1000000) / 1000000"),
):
    add(
        f"vector_expression_{name}",
        run(over("VectorExpression", POINTS, "vector", expression=text, inputColumns=columns, outputColumn={"type": "column", "value": "result"}), finish=lambda df: df.select("event_id", "result")),
        with_points(f"SELECT event_id, cast({sql} AS DOUBLE) AS result FROM pts"),
    )
SHAPES = op("MockFeatureCollectionSource", geometryType="MultiPolygon", columns={"name": "text"}, rows=[[0, 10, [[RING(0, 0, 10, 4), RING(1, 1, 3, 3)]], "a"], [0, 10, [[RING(0, 0, 2, 2)], [RING(4, 0, 6, 2)]], "b"]])
add("vector_expression_area", run(over("VectorExpression", SHAPES, "vector", expression="area(geom) * 2", outputColumn="result"), finish=flat), "SELECT * FROM (VALUES (0::BIGINT, 10::BIGINT, 'a', 72.0::DOUBLE), (0, 10, 'b', 16.0)) AS v(t_start, t_end, name, result)")
add(
    "vector_expression_centroid",
    run(over("VectorExpression", SHAPES, "vector", expression="centroid(geom)", outputColumn={"type": "geometry", "value": "MultiPoint"}), finish=lambda df: df.select("t_start", "t_end", "name", F.round(F.col("geom")[0]["x"], 6).alias("cx"), F.round(F.col("geom")[0]["y"], 6).alias("cy"))),
    "SELECT * FROM (VALUES (0::BIGINT, 10::BIGINT, 'a', round(192.0 / 36, 6)::DOUBLE, 2.0::DOUBLE), (0, 10, 'b', 3.0, 1.0)) AS v(t_start, t_end, name, cx, cy)",
)
WIDE = "w AS (SELECT t_start, t_end, y, x, max(value) FILTER (WHERE band = 0) AS a, max(value) FILTER (WHERE band = 1) AS b, max(value) FILTER (WHERE band = 2) AS c FROM r GROUP BY ALL)"
expression_sql = lambda value: f"WITH {PIXELS_SQL}, {WIDE} SELECT t_start, t_end, 0::BIGINT AS band, y, x, {value} AS value FROM w"
add("raster_expression_ndvi", run(over("Expression", RASTER, expression="if A + B == 0 { NODATA } else { (B - A) / (A + B) }", outputType="F64")), expression_sql("CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND a + b <> 0 THEN (b - a)::DOUBLE / (a + b) END"))
add("raster_expression_nodata", run(over("Expression", RASTER, expression="if A > 20 { NODATA } else { A + B + C }", outputType="I32")), expression_sql("CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND a <= 20 THEN a + b + c END"))
add("raster_expression_map_nodata", run(over("Expression", RASTER, expression="if A IS NODATA { 0 } else if B < A { 1 } else { 2 }", outputType="U8", mapNoData=True)), expression_sql("CASE WHEN a IS NULL THEN 0 WHEN b IS NULL OR b < a THEN 1 ELSE 2 END::BIGINT"))
add("bandwise_expression", run(over("BandwiseExpression", RASTER, expression="if x > 10 { x * 1.5 } else { x - 1 }", outputType="F64")), with_pixels(f"SELECT {R}, CASE WHEN value > 10 THEN value * 1.5 ELSE value - 1.0 END::DOUBLE AS value FROM r"))

# ---- unary rasters ----
add("raster_type_conversion_wrap", run(over("RasterTypeConversion", over("BandwiseExpression", RASTER, expression="x * 37 - 500", outputType="I32"), outputDataType="U8")), with_pixels(f"SELECT {R}, CASE WHEN value IS NOT NULL THEN ((value * 37 - 500) % 256 + 256) % 256 END AS value FROM r"))
add("raster_type_conversion_signed", run(over("RasterTypeConversion", over("BandwiseExpression", RASTER, expression="x * 37 - 500", outputType="I32"), outputDataType="I8")), with_pixels(f"SELECT {R}, ((value * 37 - 500 + 128) % 256 + 256) % 256 - 128 AS value FROM r"))
add("raster_type_conversion_saturate", run(over("RasterTypeConversion", over("BandwiseExpression", RASTER, expression="x * 3.7 - 50", outputType="F64"), outputDataType="U8")), with_pixels(f"SELECT {R}, cast(trunc(greatest(0, least(255, value * 3.7::DOUBLE - 50)) * CASE WHEN value IS NULL THEN NULL ELSE 1 END) AS BIGINT) AS value FROM r"))
add("raster_scaling_mul", run(over("RasterScaling", op("GdalSource", data="msg"), slope={"type": "constant", "value": 40000000}, offset={"type": "auto"}, scalingMode="mulSlopeAddOffset")), with_pixels(f"SELECT {R}, CASE WHEN value * 40000000 + 3 BETWEEN -2147483648 AND 2147483647 AND value * 40000000 BETWEEN -2147483648 AND 2147483647 THEN value * 40000000 + 3 END AS value FROM r WHERE band = 0"))
add("raster_scaling_sub", run(over("RasterScaling", op("GdalSource", data="msg"), slope={"type": "auto"}, offset={"type": "metadataKey", "key": "offset"}, scalingMode="subOffsetDivSlope")), with_pixels(f"SELECT {R}, cast(trunc((value - 3) / 2) AS BIGINT) AS value FROM r WHERE band = 0"))
add("band_filter_name", run(over("BandFilter", RASTER, bands=["c", "a"])), with_pixels("SELECT t_start, t_end, CASE band WHEN 0 THEN 0 ELSE 1 END::BIGINT AS band, y, x, value FROM r WHERE band IN (0, 2)"))
add("band_filter_index", run(over("BandFilter", RASTER, bands=[1])), with_pixels("SELECT t_start, t_end, 0::BIGINT AS band, y, x, value FROM r WHERE band = 1"))
add("radiance", run(over("Radiance", op("GdalSource", data="msg"))), with_pixels(f"SELECT {R}, (-10 + value * 0.25)::DOUBLE AS value FROM r WHERE band = 0"))
RATIO = "1.19104273e-16::DOUBLE * 1e6 * pow(2567.33, 3) / (1e-5::DOUBLE * (-10 + value * 0.25))"
KELVIN = "(0.0143877523::DOUBLE * 100 * 2567.33 / ln(1 + 1.19104273e-16::DOUBLE * 1e6 * pow(2567.33, 3) / (1e-5::DOUBLE * (-10 + value * 0.25))) - 3.41) / 0.9956"
add("temperature", run(over("BandwiseExpression", over("Temperature", op("GdalSource", data="msg")), expression="floor(x * 10)", outputType="F64"), finish=lambda df: df.withColumn("value", F.when(F.abs("value") < 1e9, F.col("value")))), with_pixels(f"SELECT {R}, CASE WHEN value = 40 THEN floor(-3.41 / 0.9956 * 10) WHEN value BETWEEN 0 AND 1023 AND {RATIO} > -1 THEN floor({KELVIN} * 10) END AS value FROM r WHERE band = 0"))
add(
    "reflectance",
    run(over("BandwiseExpression", over("Reflectance", over("RasterTypeConversion", op("GdalSource", data="visible"), outputDataType="F32")), expression="floor(x * 1000)", outputType="F64")),
    with_pixels(f"SELECT {R}, floor(value * pow(1 - 0.0167 * cos(2 * pi() * (dayofyear(make_timestamp(t_start * 1000)) - 3) / 365.0), 2) / (65.2296 / pi()) * 1000) AS value FROM r WHERE band = 0"),
)
# the sun's height where a pixel looks at, by the series of the almanac: each step of the formula is one subquery
FACTOR = repr(65536.0 / (-13642337.0 * 3000.403165817))
add(
    "reflectance_solar",
    run(over("Reflectance", over("RasterTypeConversion", op("GdalSource", data="visible"), outputDataType="F32"), solarCorrection=True), finish=lambda df: df.withColumn("value", F.floor(F.col("value") * 1000))),
    with_pixels(f"""SELECT {R}, floor(cast(value::DOUBLE * esd * esd / (65.2296::DOUBLE / pi() * cos(radians(least(zenith, 80)))) AS FLOAT)::DOUBLE * 1000) AS value
 FROM (SELECT *, degrees(z + 6371.01::DOUBLE / 149597890 * sin(z)) AS zenith FROM (SELECT *, acos(cos(radians(lat)) * cos(angle) * cos(decl) + sin(decl) * sin(radians(lat))) AS z
 FROM (SELECT *, radians((6.6974243242::DOUBLE + 0.0657098283::DOUBLE * n + hours) * 15 + lon) - atan2(cos(obl) * sin(ecl), cos(ecl)) AS angle, asin(sin(obl) * sin(ecl)) AS decl
 FROM (SELECT *, 4.895063::DOUBLE + 0.017202791698::DOUBLE * n + 0.03341607::DOUBLE * sin(anomaly) + 0.00034894::DOUBLE * sin(2 * anomaly) - 0.0001134::DOUBLE - 0.0000203::DOUBLE * sin(omega) AS ecl,
  0.4090928::DOUBLE - 6.214e-9::DOUBLE * n + 0.0000396::DOUBLE * cos(omega) AS obl, degrees(atan(1.006804::DOUBLE * (-sn * sin(b)) / sqrt(pow(s1, 2) + pow(s2, 2)))) AS lat, degrees(atan(s2 / s1)) AS lon
 FROM (SELECT *, 2.1429::DOUBLE - 0.0010394594::DOUBLE * n AS omega, 6.24006::DOUBLE + 0.0172019699::DOUBLE * n AS anomaly, 42164 - sn * cos(a) * cos(b) AS s1, sn * sin(a) * cos(b) AS s2
 FROM (SELECT *, (42164 * cos(a) * cos(b) - sqrt(pow(42164 * cos(a) * cos(b), 2) - flat * 1737121856)) / flat AS sn
 FROM (SELECT *, pow(cos(b), 2) + 1.006803::DOUBLE * pow(sin(b), 2) AS flat, days - 10957.5::DOUBLE + hours / 24 AS n, 1 - 0.0167::DOUBLE * cos(2 * pi() * (dayofyear(make_timestamp(t_start * 1000)) - 3) / 365) AS esd
 FROM (SELECT *, radians((-180 + (x + 0.5) * 22.5)::DOUBLE * -({FACTOR}::DOUBLE)) AS a, radians((90 - (y + 0.5) * 22.5)::DOUBLE * {FACTOR}::DOUBLE) AS b, t_start // 86400000 AS days, (t_start % 86400000 // 1000) / 3600.0::DOUBLE AS hours FROM r WHERE band = 0))))))))"""),
)

# ---- resampling ----
add("interpolation_nn", run(over("Interpolation", RASTER, interpolation="nearestNeighbor", outputResolution={"type": "fraction", "x": 3, "y": 2})), with_pixels("SELECT t_start, t_end, band, i.range AS y, j.range AS x, value FROM r, range(16) AS i, range(48) AS j WHERE r.y = i.range // 2 AND r.x = j.range // 3"))
add(
    "interpolation_bilinear",
    run(over("Interpolation", over("RasterTypeConversion", RASTER, outputDataType="F64"), interpolation="biLinear", outputResolution={"type": "fraction", "x": 2, "y": 2})),
    with_pixels(f"""SELECT a.t_start, a.t_end, a.band, i.range AS y, j.range AS x,
 ((a.value * (1 - (j.range % 2) / 2) + b.value * (j.range % 2) / 2) * (1 - (i.range % 2) / 2) + (c.value * (1 - (j.range % 2) / 2) + d.value * (j.range % 2) / 2) * (i.range % 2) / 2)::DOUBLE AS value
 FROM r AS a JOIN range(16) AS i ON a.y = i.range // 2 JOIN range(32) AS j ON a.x = j.range // 2
 LEFT JOIN r AS b ON b.t_start = a.t_start AND b.band = a.band AND b.y = a.y AND b.x = a.x + 1
 LEFT JOIN r AS c ON c.t_start = a.t_start AND c.band = a.band AND c.y = a.y + 1 AND c.x = a.x
 LEFT JOIN r AS d ON d.t_start = a.t_start AND d.band = a.band AND d.y = a.y + 1 AND d.x = a.x + 1"""),
)
add("downsampling_nn", run(over("Downsampling", RASTER, outputResolution={"type": "fraction", "x": 3, "y": 2})), with_pixels("SELECT t_start, t_end, band, y // 2 AS y, x // 3 AS x, value FROM r WHERE y % 2 = 1 AND x % 3 = 1"))
MERC = 6378137.0
add(
    "reprojection_4326_3857",
    run(over("Reprojection", POINTS, "source", targetSpatialReference="EPSG:3857"), finish=lambda df: df.select("event_id", F.round(F.col("geom")[0]["x"], 3).alias("mx"), F.round(F.col("geom")[0]["y"], 3).alias("my"))),
    with_points(f"SELECT event_id, round(radians(px) * {MERC}, 3) AS mx, round(ln(tan(radians(py) / 2 + pi() / 4)) * {MERC}, 3) AS my FROM pts"),
)
add(
    "reprojection_3857_4326",
    run(over("Reprojection", over("Reprojection", POINTS, "source", targetSpatialReference="EPSG:3857"), "source", targetSpatialReference="EPSG:4326"), Rect(bbox=(-100.5, -40.5, 95.5, 45.5)), finish=lambda df: df.select("event_id", F.round(F.col("geom")[0]["x"], 6).alias("lon"), F.round(F.col("geom")[0]["y"], 6).alias("lat"))),
    with_points("SELECT event_id, round(px, 6) AS lon, round(py, 6) AS lat FROM pts WHERE px BETWEEN -100.5 AND 95.5 AND py BETWEEN -40.5 AND 45.5"),
)
# the transverse Mercator projection as series in the distance from the meridian, which hold inside a zone
E2 = 0.0066943799901413165
E1 = E2 / (1 - E2)
ARC = f"6378137.0 * ({1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256!r} * f - {3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024!r} * sin(2 * f) + {15 * E2**2 / 256 + 45 * E2**3 / 1024!r} * sin(4 * f) - {35 * E2**3 / 3072!r} * sin(6 * f))"
add(
    "reprojection_utm",
    run(over("Reprojection", POINTS, "source", targetSpatialReference="EPSG:32631"), Rect(bbox=(166021.0, 0.0, 833979.0, 9329005.0)), finish=lambda df: df.select("event_id", F.round(F.col("geom")[0]["x"], 1).alias("easting"), F.round(F.col("geom")[0]["y"], 1).alias("northing"))),
    with_points(f"""SELECT event_id, round(500000 + 0.9996 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - {58 * E1!r}) * pow(a, 5) / 120), 1) AS easting,
 round(0.9996 * ({ARC} + n * tan(f) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - {330 * E1!r}) * pow(a, 6) / 720)), 1) AS northing
 FROM (SELECT event_id, f, 6378137.0 / sqrt(1 - {E2!r} * pow(sin(f), 2)) AS n, pow(tan(f), 2) AS t, {E1!r} * pow(cos(f), 2) AS c, l * cos(f) AS a
 FROM (SELECT event_id, radians(py) AS f, radians(px - 3) AS l FROM pts WHERE px BETWEEN 0 AND 6 AND py BETWEEN 0 AND 84))"""),
)
# a geostationary satellite's view: the ray from it to a place on the ellipsoid, in kilometres
FLAT2 = repr((1 - 1 / 298.257223563) ** 2)
add(
    "reprojection_geostationary",
    run(over("Reprojection", POINTS, "source", targetSpatialReference="SR-ORG:81"), finish=lambda df: df.select("event_id", F.round(F.col("geom")[0]["x"], 3).alias("east"), F.round(F.col("geom")[0]["y"], 3).alias("north"))),
    with_points(f"""SELECT event_id, round(35785831 * atan(w / q), 3) AS east, round(35785831 * asin(v / sqrt(q * q + w * w + v * v)), 3) AS north
 FROM (SELECT *, 42163.968::DOUBLE - u AS q FROM (SELECT event_id, n * cos(f) * cos(l) AS u, n * cos(f) * sin(l) AS w, n * {FLAT2} * sin(f) AS v
 FROM (SELECT event_id, radians(py) AS f, radians(px) AS l, 6378.137::DOUBLE / sqrt(1 - (1 - {FLAT2}) * pow(sin(radians(py)), 2)) AS n FROM pts))) WHERE u * 42163.968 >= pow(6378.137, 2)"""),
)
EDGE, ORBIT2 = 5568748.276, repr(42163968.0**2 - 6378137.0**2)
add(
    "reprojection_raster_geostationary",
    run(over("Reprojection", RASTER, "source", targetSpatialReference="SR-ORG:81")),
    with_pixels(f"""SELECT s.t_start, s.t_end, s.band, g.y, g.x, r.value FROM (SELECT DISTINCT t_start, t_end, band FROM r) AS s
 CROSS JOIN (SELECT y, x, floor((90 - degrees(atan(k * v / {FLAT2} / sqrt(pow(42163968 - k, 2) + pow(k * u, 2))))) / 22.5) AS py, floor((degrees(atan2(k * u, 42163968 - k)) + 180) / 22.5) AS px
 FROM (SELECT *, CASE WHEN d >= 0 THEN (42163968 - sqrt(d)) / q END AS k FROM (SELECT *, pow(42163968::DOUBLE, 2) - q * {ORBIT2} AS d FROM (SELECT *, 1 + u * u + v * v / {FLAT2} AS q
 FROM (SELECT *, tan(({EDGE} - (y + 0.5) * {EDGE / 4!r}) / 35785831) * sqrt(1 + u * u) AS v FROM (SELECT i.range AS y, j.range AS x, tan((-{EDGE} + (j.range + 0.5) * {EDGE / 8!r}) / 35785831) AS u FROM range(8) AS i, range(16) AS j)))))) AS g
 LEFT JOIN r ON r.t_start = s.t_start AND r.band = s.band AND r.y = g.py AND r.x = g.px"""),
)
TOP = "ln(tan(radians(85.06) / 2 + pi() / 4))"
add(
    "reprojection_raster",
    run(over("Reprojection", ONE, "source", targetSpatialReference="EPSG:3857")),
    with_pixels(f"""SELECT t_start, t_end, 0::BIGINT AS band, i.range AS y, x, value FROM r JOIN range(8) AS i
 ON r.y = floor((90 - degrees(2 * atan(exp({TOP} * (1 - (i.range + 0.5) / 4))) - pi() / 2)) / 22.5) WHERE band = 0"""),
)

# ---- temporal aggregation ----
THREE = {"granularity": "days", "step": 3}
window_of = f"cast(floor(t_start / {3 * DAY}) * {3 * DAY} AS BIGINT)"
# windows reach beyond the dataset's time, where slices are without data: a strict aggregate needs all three days
AGG = {
    "min": "min(value)", "max": "max(value)", "mean": "cast(trunc(avg(value)) AS BIGINT)", "sum": "cast(sum(value) AS BIGINT)", "count": "count(value)",
    "first": ("arg_min(value, t_start)", f"CASE WHEN min(t_start) = {window_of} THEN arg_min_null(value, t_start) END"),
    "last": ("arg_max(value, t_start)", f"CASE WHEN max(t_end) = {window_of} + {3 * DAY} THEN arg_max_null(value, t_start) END"),
}
for name, sql in AGG.items():
    for strict in (False, True):
        body = sql[strict] if isinstance(sql, tuple) else f"CASE WHEN count(value) = 3 THEN {sql} END" if strict else sql
        add(
            f"temporal_agg_{name}_{'strict' if strict else 'ignore'}",
            run(over("TemporalRasterAggregation", RASTER, aggregation={"type": name, "ignoreNoData": not strict}, window=THREE)),
            with_pixels(f"SELECT {window_of} AS t_start, {window_of} + {3 * DAY} AS t_end, band, y, x, {body} AS value FROM r GROUP BY {window_of}, band, y, x"),
        )
add("temporal_agg_percentile", run(over("TemporalRasterAggregation", RASTER, aggregation={"type": "percentileEstimate", "percentile": 0.5, "ignoreNoData": True}, window=THREE, outputType="F64")), with_pixels(f"SELECT {window_of} AS t_start, {window_of} + {3 * DAY} AS t_end, band, y, x, quantile_cont(value::DOUBLE, 0.5) AS value FROM r GROUP BY {window_of}, band, y, x"))
month_of = "epoch_ms(date_trunc('month', make_timestamp(t_start * 1000)))"
add(
    "temporal_agg_month_window",
    run(over("TemporalRasterAggregation", RASTER, aggregation={"type": "mean", "ignoreNoData": True}, window={"granularity": "months", "step": 1}, outputType="F64"), finish=rounded("value")),
    with_pixels(f"SELECT {month_of} AS t_start, epoch_ms(date_trunc('month', make_timestamp(t_start * 1000)) + INTERVAL 1 MONTH) AS t_end, band, y, x, round(avg(value::DOUBLE), 6) AS value FROM r GROUP BY 1, 2, band, y, x"),
)
add(
    "temporal_agg_overlap",
    run(over("TemporalRasterAggregation", over("TemporalRasterAggregation", ONE, aggregation={"type": "sum", "ignoreNoData": True}, window=THREE), aggregation={"type": "sum", "ignoreNoData": True}, window={"granularity": "days", "step": 2})),
    with_pixels(f"""SELECT w AS t_start, w + {2 * DAY} AS t_end, 0::BIGINT AS band, y, x, cast(sum(value) AS BIGINT) AS value FROM (
 SELECT s, y, x, value, unnest(range(cast(floor(s / {2 * DAY}) AS BIGINT), cast(floor((s + {3 * DAY} - 1) / {2 * DAY}) AS BIGINT) + 1)) * {2 * DAY} AS w
 FROM (SELECT {window_of} AS s, y, x, sum(value) AS value FROM r WHERE band = 0 GROUP BY {window_of}, y, x)) WHERE w < {T0 + 30 * DAY} AND w + {2 * DAY} > {T0} GROUP BY w, y, x"""),
)

# ---- rasters with gaps ----
SPARSE = op("MultiBandGdalSource", data="sparse")
with_sparse = lambda body: f"WITH {SPARSE_SQL} {body}"
add("mosaic_sparse", run(SPARSE), with_sparse("SELECT t_start, t_end, band, y, x, value FROM sm"))
add("mosaic_overview", run(op("MultiBandGdalSource", data="sparse", overviewLevel=2)), with_sparse("SELECT t_start, t_end, band, y // 2 AS y, x // 2 AS x, value FROM sm WHERE y % 2 = 0 AND x % 2 = 0"))
add(
    "neighborhood_over_sparse_mosaic",
    run(over("NeighborhoodAggregate", SPARSE, neighborhood={"type": "rectangle", "dimensions": [1, 3]}, aggregateFunction="standardDeviation"), finish=rounded("value")),
    with_sparse("""SELECT p.t_start, p.t_end, p.band, p.y, p.x, CASE WHEN count(n.value) >= 2 THEN cast(trunc(stddev_pop(n.value)) AS BIGINT) END AS value
 FROM sm AS p LEFT JOIN sm AS n ON n.t_start = p.t_start AND n.band = p.band AND n.y = p.y AND n.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY ALL"""),
)
add(
    "neighborhood_sum_over_sparse_mosaic",
    run(over("NeighborhoodAggregate", SPARSE, neighborhood={"type": "weightsMatrix", "weights": [[1], [2], [1]]}, aggregateFunction="sum")),
    with_sparse("""SELECT p.t_start, p.t_end, p.band, p.y, p.x, a.value + 2 * p.value + b.value AS value FROM sm AS p
 LEFT JOIN sm AS a ON a.t_start = p.t_start AND a.band = p.band AND a.x = p.x AND a.y = p.y - 1 LEFT JOIN sm AS b ON b.t_start = p.t_start AND b.band = p.band AND b.x = p.x AND b.y = p.y + 1"""),
)
GAPS = (T0 - 4 * DAY, T0 + 7 * DAY)
for strict in (False, True):
    add(
        f"temporal_agg_with_gaps_{'strict' if strict else 'ignore'}",
        run(over("TemporalRasterAggregation", SPARSE, aggregation={"type": "sum", "ignoreNoData": not strict}, window={"granularity": "days", "step": 1}), Rect(time=GAPS)),
        with_sparse(f"""SELECT {T0} + d.range * {DAY} AS t_start, {T0} + (d.range + 1) * {DAY} AS t_end, cast(b.range AS BIGINT) AS band, cast(i.range AS BIGINT) AS y, cast(j.range AS BIGINT) AS x, value
 FROM range(-4, 7) AS d, range(2) AS b, range(8) AS i, range(16) AS j LEFT JOIN sm ON sm.t_start = {T0} + d.range * {DAY} AND band = b.range AND y = i.range AND x = j.range"""),
    )

# ---- neighbourhoods ----
KERNEL = [[1, 2, 1], [0, 3, 0], [-1, 0, 2]]
DENSE = over("Expression", over("BandFilter", RASTER, bands=["a"]), expression="if A IS NODATA { 1 } else { A }", outputType="I64", mapNoData=True)
full = "f AS (SELECT t_start, t_end, y, x, coalesce(value, 1) AS value FROM r WHERE band = 0)"
near = "FROM {src} AS p LEFT JOIN (SELECT i.range AS dy, j.range AS dx, {w} AS w FROM range(-1, 2) AS i, range(-1, 2) AS j) AS k ON true LEFT JOIN {src} AS n ON n.t_start = p.t_start AND n.y = p.y + dy AND n.x = p.x + dx GROUP BY p.t_start, p.t_end, p.y, p.x"
weights = "(" + str(KERNEL).replace("[[", "[[").replace("], [", "], [") + ")[i.range + 2][j.range + 2]"
for name, hood, w in (("sum", {"type": "rectangle", "dimensions": [3, 3]}, "1"), ("weights", {"type": "weightsMatrix", "weights": KERNEL}, weights)):
    add(
        f"neighborhood_{name}",
        run(over("NeighborhoodAggregate", DENSE, neighborhood=hood, aggregateFunction="sum")),
        f"WITH {PIXELS_SQL}, {full} SELECT p.t_start, p.t_end, 0::BIGINT AS band, p.y, p.x, CASE WHEN count(n.value) = count(*) THEN cast(sum(n.value * w) AS BIGINT) END AS value {near.format(src='f', w=w)}",
    )
sparse = "f AS (SELECT t_start, t_end, y, x, value FROM r WHERE band = 0)"
add(
    "neighborhood_stddev",
    run(over("NeighborhoodAggregate", over("RasterTypeConversion", ONE, outputDataType="F64"), neighborhood={"type": "rectangle", "dimensions": [3, 3]}, aggregateFunction="standardDeviation"), finish=rounded("value")),
    f"WITH {PIXELS_SQL}, {sparse} SELECT p.t_start, p.t_end, 0::BIGINT AS band, p.y, p.x, CASE WHEN count(n.value) >= 2 THEN round(stddev_pop(n.value * w), 6) END AS value {near.format(src='f', w='1.0')}",
)
add(
    "band_neighborhood_derivative",
    run(over("BandNeighborhoodAggregate", RASTER, aggregate={"type": "firstDerivative", "bandDistance": {"type": "equallySpaced", "distance": 2.0}})),
    with_pixels(f"SELECT {R}, (CASE band WHEN 0 THEN (lead(value) OVER w - value) / 2.0 WHEN 2 THEN (value - lag(value) OVER w) / 2.0 ELSE (lead(value) OVER w - lag(value) OVER w) / 4.0 END)::DOUBLE AS value FROM r WINDOW w AS (PARTITION BY t_start, y, x ORDER BY band)"),
)
add(
    "band_neighborhood_average",
    run(over("BandNeighborhoodAggregate", RASTER, aggregate={"type": "average", "windowSize": 3})),
    with_pixels(f"SELECT {R}, CASE WHEN count(value) OVER w = count(*) OVER w THEN avg(value) OVER w END AS value FROM r WINDOW w AS (PARTITION BY t_start, y, x ORDER BY band ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"),
)

# ---- stacking, rasterisation, raster and vector ----
add(
    "raster_stacker_aligned",
    run(op("RasterStacker", {"rasters": [over("BandFilter", RASTER, bands=["b"]), over("BandFilter", RASTER, bands=["a", "c"])]})),
    with_pixels("SELECT t_start, t_end, CASE band WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END::BIGINT AS band, y, x, value FROM r"),
)
THREE_DAYS = over("TemporalRasterAggregation", ONE, aggregation={"type": "sum", "ignoreNoData": True}, window=THREE)
add(
    "raster_stacker_irregular",
    run(op("RasterStacker", {"rasters": [ONE, THREE_DAYS]}, renameBands={"type": "rename", "values": ["day", "three"]})),
    with_pixels(f"""SELECT t_start, t_end, 0::BIGINT AS band, y, x, value FROM r WHERE band = 0 UNION ALL SELECT d.t_start, d.t_end, 1::BIGINT, a.y, a.x, a.value FROM (SELECT DISTINCT t_start, t_end FROM r) AS d
 JOIN (SELECT {window_of} AS s, y, x, cast(sum(value) AS BIGINT) AS value FROM r WHERE band = 0 GROUP BY {window_of}, y, x) AS a ON cast(floor(d.t_start / {3 * DAY}) * {3 * DAY} AS BIGINT) = a.s"""),
)
add(
    "rasterization_grid",
    run(over("Rasterization", POINTS, "vector", spatialResolution={"x": 30.0, "y": 30.0}, mode="grid", origin=[-180.0, 90.0]), Rect(time=WEEK, pixels=(0, 5, 0, 11))),
    with_points(f"""SELECT {WEEK[0]} AS t_start, {WEEK[1]} AS t_end, 0::BIGINT AS band, i.range AS y, j.range AS x, coalesce(n, 0)::DOUBLE AS value FROM range(6) AS i CROSS JOIN range(12) AS j
 LEFT JOIN (SELECT floor((90 - py) / 30) AS gy, floor((px + 180) / 30) AS gx, count(*) AS n FROM pts WHERE {in_week} GROUP BY ALL) ON gy = i.range AND gx = j.range"""),
)
REACH = 36.0
add(
    "rasterization_density",
    run(over("Rasterization", POINTS, "vector", spatialResolution={"x": 12.0, "y": 12.0}, mode="density", origin=[-180.0, 90.0], cutoff=0.05, stddev=12.0), Rect(time=WEEK, pixels=(0, 14, 0, 29)), finish=rounded("value")),
    with_points(f"""SELECT {WEEK[0]} AS t_start, {WEEK[1]} AS t_end, 0::BIGINT AS band, i.range AS y, j.range AS x,
 round(coalesce(sum(exp(-(pow(px + 180 - (j.range + 0.5) * 12, 2) + pow(90 - py - (i.range + 0.5) * 12, 2)) / 288) / (sqrt(2 * pi()) * 12)), 0), 6) AS value
 FROM range(15) AS i CROSS JOIN range(30) AS j LEFT JOIN (SELECT px, py FROM pts WHERE {in_week}) ON sqrt(pow(px + 180 - (j.range + 0.5) * 12, 2) + pow(90 - py - (i.range + 0.5) * 12, 2)) <= {REACH} GROUP BY ALL"""),
)
pixel_of = "y = floor((90 - py) / 22.5) AND x = floor((px + 180) / 22.5)"
touching = "((p.t_start >= r.t_start AND p.t_start < r.t_end) OR (r.t_start >= p.t_start AND r.t_start < p.t_end))"
few = lambda df: df.select("t_start", "t_end", "event_id", "a")
add(
    "raster_vector_join_none",
    run(op("RasterVectorJoin", {"vector": POINTS, "rasters": [ONE]}, featureAggregation="first", temporalAggregation="none"), finish=few),
    both(f"SELECT coalesce(greatest(p.t_start, r.t_start), p.t_start) AS t_start, coalesce(least(p.t_end, r.t_end), p.t_end) AS t_end, event_id, r.value AS a FROM pts AS p LEFT JOIN r ON band = 0 AND {pixel_of} AND {touching}"),
)
add(
    "raster_vector_join_first",
    run(op("RasterVectorJoin", {"vector": POINTS, "rasters": [ONE]}, featureAggregation="first", temporalAggregation="first", temporalAggregationIgnoreNoData=True), finish=few),
    both(f"SELECT p.t_start, p.t_end, event_id, coalesce(arg_min(r.value, r.t_start), 0) AS a FROM pts AS p LEFT JOIN r ON band = 0 AND {pixel_of} AND {touching} GROUP BY ALL"),
)
add(
    "raster_vector_join_mean",
    run(op("RasterVectorJoin", {"vector": POINTS, "rasters": [RASTER]}, featureAggregation="mean", temporalAggregation="mean", featureAggregationIgnoreNoData=True, temporalAggregationIgnoreNoData=True), finish=lambda df: rounded("a", "b", "c")(df.select("event_id", "a", "b", "c"))),
    both("SELECT event_id, " + ", ".join(f"round(coalesce(avg(r.value) FILTER (WHERE band = {k}), 0), 6) AS {c}" for k, c in enumerate("abc")) + f" FROM pts AS p LEFT JOIN r ON {pixel_of} AND {touching} GROUP BY event_id"),
)
FIELDS = op("MockFeatureCollectionSource", geometryType="MultiPolygon", columns={"name": "text"}, rows=[[*WEEK, [[RING(-100, -30, 60, 50)]], "big"], [*WEEK, [[RING(70, 10, 130, 60)]], "small"]])
add(
    "raster_vector_join_polygon",
    run(op("RasterVectorJoin", {"vector": FIELDS, "rasters": [over("RasterTypeConversion", ONE, outputDataType="F64")]}, featureAggregation="mean", temporalAggregation="none", featureAggregationIgnoreNoData=True), finish=lambda df: rounded("a")(df.select("t_start", "t_end", "name", "a"))),
    with_pixels(f"""SELECT greatest(t_start, {WEEK[0]}) AS t_start, least(t_end, {WEEK[1]}) AS t_end, name, round(avg(value), 6) AS a FROM r JOIN (VALUES ('big', -100, -30, 60, 50), ('small', 70, 10, 130, 60)) AS f(name, x0, y0, x1, y1)
 ON -180 + x * 22.5 BETWEEN x0 AND x1 AND 90 - y * 22.5 BETWEEN y0 AND y1 WHERE band = 0 AND {in_week} GROUP BY 1, 2, 3"""),
)

# ---- Python behind Arrow ----
LINES = op("MockFeatureCollectionSource", geometryType="MultiLineString", columns={"name": "text"}, rows=[[0, 10, [[[i, (i * 7) % 5 / 10] for i in range(40)]], "zigzag"], [0, 10, [[[i, 0] for i in range(40)]], "straight"]])
counted = lambda df: df.select("name", F.size(F.col("geom")[0]).alias("points"))
add("line_simplification_dp", run(over("LineSimplification", LINES, "vector", algorithm="douglasPeucker", epsilon=1.0), finish=counted), "SELECT * FROM (VALUES ('zigzag', 2::BIGINT), ('straight', 2)) AS v(name, points)")
add("line_simplification_vw", run(over("LineSimplification", LINES, "vector", algorithm="visvalingam", epsilon=0.05), finish=counted))
CLUSTERS = over("VisualPointClustering", POINTS, "vector", minRadiusPx=4.0, deltaPx=1.0, resolution=2.0, columnAggregates={"mean_value": {"columnName": "value", "aggregateType": "meanNumber"}, "types": {"columnName": "event_type", "aggregateType": "stringSample"}})
add("visual_point_clustering", run(CLUSTERS, finish=rounded("radius", "mean_value")))


def cluster_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage one of the clustering: points by cell."""
    df = from_json(CLUSTERS).cells(context(spark, sf_dir), Rect())
    return canonical(df.select("cx", "cy", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "t_start", "t_end"))


CELL = 9 / 2**0.5 * 2
add("visual_point_clustering_cells", cluster_cells, with_points(f"SELECT cast(floor(px / {CELL}) AS BIGINT) AS cx, cast(floor(py / {CELL}) AS BIGINT) AS cy, count(*) AS n, round(avg(px), 6) AS x, round(avg(py), 6) AS y, min(t_start) AS t_start, max(t_end) AS t_end FROM pts GROUP BY 1, 2"))


def tile_mean(x: np.ndarray) -> np.ndarray:
    """A model of whole tiles: each pixel gets the mean of its tile's first band."""
    return np.broadcast_to(x[..., 0].mean(axis=(1, 2), keepdims=True), x.shape[:3])


def with_model(ctx: Context) -> None:
    ctx.models["m"] = Model(linear((0.5, 2.0, -1.0), 4.0), 3, "I32", "F64")
    ctx.models["file"] = Model(onnx_linear((0.5, 2.0, -1.0), 4.0), 3, "F32", "F32")
    ctx.models["tile"] = Model(tile_mean, 3, "I32", "F64", input_no_data=0.0, tile=(4, 8))


add("onnx_like", run(over("Onnx", RASTER, model="m"), prepare=with_model), expression_sql("(0.5 * a + 2.0 * b - c + 4.0)::DOUBLE"))

add("onnx_file", run(over("Onnx", over("RasterTypeConversion", RASTER, outputDataType="F32"), model="file"), prepare=with_model), expression_sql("(0.5 * a + 2.0 * b - c + 4.0)::DOUBLE"))
add(
    "onnx_tiles",
    run(over("Onnx", RASTER, model="tile"), prepare=with_model, finish=rounded("value")),
    f"WITH {PIXELS_SQL}, {WIDE}, m AS (SELECT t_start, y // 4 AS ty, x // 8 AS tx, round(avg(coalesce(a, 0)), 6) AS value FROM w GROUP BY ALL) SELECT w.t_start, t_end, 0::BIGINT AS band, y, x, CASE WHEN coalesce(a, b, c) IS NOT NULL THEN value END AS value FROM w JOIN m ON m.t_start = w.t_start AND ty = y // 4 AND tx = x // 8",
)

# ---- plots ----
STATS = "count(*) AS \"valueCount\", count({v}) AS \"validCount\", coalesce(min({v})::DOUBLE, 'nan') AS min, coalesce(max({v})::DOUBLE, 'nan') AS max, round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS stddev, round(quantile_cont({v}::DOUBLE, 0.25), 6) AS \"p0.25\""
add(
    "statistics_vector",
    run(op("Statistics", {"source": POINTS}, columnNames=["maybe", "value"], percentiles=[0.25]), finish=lambda df: df.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)}).withColumnRenamed("p0.25", "p25")),
    with_points(" UNION ALL ".join(f"SELECT '{c}' AS name, {STATS.format(v=c)} FROM pts" for c in ("maybe", "value"))).replace('"p0.25"', "p25"),
)
add(
    "statistics_raster",
    run(op("Statistics", {"source": [RASTER]}, percentiles=[0.25]), finish=lambda df: df.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)}).withColumnRenamed("p0.25", "p25")),
    with_pixels(f"SELECT 'a' AS name, {STATS.format(v='value')} FROM r WHERE band = 0").replace('"p0.25"', "p25"),
)
add(
    "histogram_fixed",
    run(op("Histogram", {"source": POINTS}, attributeName="value", bounds={"min": 0, "max": 40}, buckets={"type": "number", "value": 8})),
    with_points("SELECT b.range AS bucket, b.range * 5.0::DOUBLE AS bucket_start, (b.range + 1) * 5.0::DOUBLE AS bucket_end, count(v) AS frequency FROM range(8) AS b LEFT JOIN (SELECT least(floor(value / 5), 7) AS v FROM pts WHERE value BETWEEN 0 AND 40) ON v = b.range GROUP BY ALL"),
)
add(
    "histogram_sqrt",
    run(op("Histogram", {"source": ONE}, buckets={"type": "squareRootChoiceRule", "maxNumberOfBuckets": 16}), finish=rounded("bucket_start", "bucket_end")),
    with_pixels("""SELECT b.range AS bucket, round(lo + b.range * (hi - lo) / n, 6) AS bucket_start, round(lo + (b.range + 1) * (hi - lo) / n, 6) AS bucket_end, count(v) AS frequency
 FROM (SELECT min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi, least(16, floor(sqrt(count(value))))::BIGINT AS n FROM r WHERE band = 0), range(16) AS b
 LEFT JOIN (SELECT value AS v FROM r WHERE band = 0 AND value IS NOT NULL) ON least(floor((v - lo) / (hi - lo) * n), n - 1) = b.range WHERE b.range < n GROUP BY ALL"""),
)
add(
    "class_histogram",
    run(op("ClassHistogram", {"source": op("GdalSource", data="classes")})),
    with_pixels("SELECT b.range AS class_id, 'class ' || b.range AS label, count(v) AS frequency FROM range(6) AS b LEFT JOIN (SELECT (value % 8 + 8) % 8 AS v FROM r WHERE band = 0) ON v = b.range GROUP BY ALL"),
)
add("pie_chart", run(op("PieChart", {"vector": POINTS}, columnName="event_type")), with_points("SELECT event_type AS slice, count(*) AS n FROM pts WHERE event_type <> '' GROUP BY ALL"))
add(
    "box_plot_exact",
    run(op("BoxPlot", {"source": POINTS}, columnNames=["value"])),
    with_points(f"""SELECT 'value' AS name, min(value) AS min, quantile_cont(value, 0.5) FILTER (WHERE k <= n // 2) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.5) FILTER (WHERE k > n - n // 2) AS q3, max(value) AS max, true AS is_exact
 FROM (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM pts)"""),
)
add("scatter_points", run(op("ScatterPlot", {"vector": op("MockDatasetDataSource", data="nations")}, columnX="n_nationkey", columnY="n_regionkey")), "SELECT n_nationkey::DOUBLE AS x, n_regionkey::DOUBLE AS y FROM nation")
add(
    "scatter_hist2d",
    run(op("ScatterPlot", {"vector": POINTS}, columnX="user_id", columnY="value")),
    with_points("""SELECT cast(least(floor((user_id - x0) / (x1 - x0) * s), s - 1) AS BIGINT) AS bucket_x, cast(least(floor((value - y0) / (y1 - y0) * s), s - 1) AS BIGINT) AS bucket_y, count(*) AS n
 FROM pts, (SELECT min(user_id)::DOUBLE AS x0, max(user_id)::DOUBLE AS x1, min(value) AS y0, max(value) AS y1, least(100, floor(sqrt(count(*)))) AS s FROM pts) GROUP BY ALL"""),
)
add("mean_raster_over_time", run(op("MeanRasterPixelValuesOverTime", {"raster": RASTER}, timePosition="center"), finish=rounded("mean")), with_pixels("SELECT (t_start + t_end) // 2 AS t, round(avg(value), 6) AS mean FROM r WHERE band = 0 GROUP BY ALL"))
add(
    "attribute_over_time",
    run(op("FeatureAttributeValuesOverTime", {"vector": POINTS}, idColumn="user_id", valueColumn="value")),
    with_points("SELECT user_id::VARCHAR AS series, t_start AS t, value FROM pts WHERE user_id::VARCHAR IN (SELECT s FROM (SELECT user_id::VARCHAR AS s, min(t_start) AS f FROM pts GROUP BY ALL ORDER BY f, s LIMIT 20)) AND value IS NOT NULL"),
)


# ---- streaming ----
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream: counts by day and type."""
    from terrafold.streaming.windows import counts_in_windows, read_features, run_to_table

    stream = read_features(spark, f"{sf_dir}/[e]vents.parquet")
    return canonical(run_to_table(counts_in_windows(stream, "ts", ["event_type"]), f"windows_{uuid.uuid4().hex}", shared_path(spark)))


add("stream_tumbling_windows", stream_windows, f"SELECT (epoch_us(ts) // {DAY * 1000}) * {DAY} AS w_start, event_type, count(*) AS n, cast(sum(floor(value)) AS BIGINT) AS total FROM events GROUP BY ALL")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDVI of two bands, by month, as columns of the points inside a region."""
    ndvi = over("Expression", over("BandFilter", RASTER, bands=["a", "b"]), expression="(B - A) / (A + B + 1)", outputType="F64", outputBand="ndvi")
    monthly = over("TemporalRasterAggregation", ndvi, aggregation={"type": "mean", "ignoreNoData": True}, window={"granularity": "months", "step": 1})
    region = op("PointInPolygonFilter", {"points": POINTS, "polygons": op("MockFeatureCollectionSource", geometryType="MultiPolygon", rows=AREAS["hole"][0])})
    graph = op("RasterVectorJoin", {"vector": region, "rasters": [monthly]}, featureAggregation="first", temporalAggregation="none")
    return run(graph, finish=lambda df: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ndvi"), 6).alias("ndvi")))(spark, sf_dir)


add(
    "flagship_monthly_ndvi",
    flagship,
    f"""WITH {POINTS_SQL}, {PIXELS_SQL}, {WIDE},
m AS (SELECT {month_of} AS s, epoch_ms(date_trunc('month', make_timestamp(t_start * 1000)) + INTERVAL 1 MONTH) AS e, y, x, avg((b - a)::DOUBLE / (a + b + 1)) AS ndvi FROM w GROUP BY ALL)
SELECT event_type, count(*) AS n, round(avg(ndvi), 6) AS ndvi FROM pts AS p LEFT JOIN m ON y = floor((90 - py) / 22.5) AND x = floor((px + 180) / 22.5)
 AND ((p.t_start >= s AND p.t_start < e) OR (s >= p.t_start AND s < p.t_end)) WHERE {AREAS['hole'][1]} GROUP BY event_type""",
)
