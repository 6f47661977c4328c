"""Deterministic points, rasters and data rows from the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.engine.graph import Context
from terrafold.functions import geometry
from terrafold.model.descriptor import Band, GeoTransform, Measurement, RasterDescriptor, VectorDescriptor
from terrafold.model.time import MAX_MS, MIN_MS, TimeStep

DAY, HOUR, T0 = 86_400_000, 3_600_000, 1_704_067_200_000  # T0: 1 January 2024
ROWS, COLS, BANDS = 8, 16, 3
GRID = GeoTransform(-180.0, 90.0, 22.5, -22.5)


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp's own date and time, whatever the session's zone."""
    parts = F.unix_date(ts.cast("date")).cast("long") * DAY + F.hour(ts) * HOUR + F.minute(ts) * 60_000
    return (parts + F.floor(F.extract(F.lit("SECOND"), ts) * 1000)).cast("long")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    t = epoch_ms(F.col("ts"))
    x, y = F.pmod("user_id", F.lit(36)) * 10.0 - 175, 85 - F.pmod("event_id", F.lit(18)) * 10.0
    return e.select(t.alias("t_start"), (t + HOUR).alias("t_end"), geometry.multi_point(x, y).alias("geom"), "event_id", "user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("maybe"), F.floor("value").cast("double").alias("value"))


POINTS_SQL = f"""pts AS (SELECT epoch_us(ts) // 1000 AS t_start, epoch_us(ts) // 1000 + {HOUR} AS t_end, cast((user_id % 36) * 10 - 175 AS DOUBLE) AS px, cast(85 - (event_id % 18) * 10 AS DOUBLE) AS py,
 event_id, user_id, event_type, CASE WHEN event_id % 7 <> 0 THEN user_id END AS maybe, floor(value) AS value FROM events)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    day = F.floor(epoch_ms(F.col("ts")) / DAY)
    own = e.select(day.alias("day"), (F.col("user_id") % BANDS).cast("int").alias("band"), (F.col("event_id") % ROWS).cast("int").alias("y"), ((F.floor(F.col("event_id") / ROWS) + F.col("user_id")) % COLS).cast("int").alias("x"), F.floor("value").alias("v"))
    summed = own.groupBy("day", "band", "y", "x").agg(F.sum("v").alias("v"))
    grid = own.select("day").distinct()
    for name, n in (("band", BANDS), ("y", ROWS), ("x", COLS)):
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dense = grid.join(summed, ["day", "band", "y", "x"], "left")
    return dense.select((F.col("day") * DAY).alias("t_start"), ((F.col("day") + 1) * DAY).alias("t_end"), "band", "y", "x", F.col("v").cast("int").alias("value"))


PIXELS_SQL = f"""ev AS (SELECT epoch_us(ts) // {DAY * 1000} AS day, user_id % {BANDS} AS band, event_id % {ROWS} AS y, (event_id // {ROWS} + user_id) % {COLS} AS x, cast(floor(value) AS BIGINT) AS v FROM events),
summed AS (SELECT day, band, y, x, cast(sum(v) AS BIGINT) AS v FROM ev GROUP BY ALL),
grid AS (SELECT day, cast(b.range AS BIGINT) AS band, cast(i.range AS BIGINT) AS y, cast(j.range AS BIGINT) AS x FROM (SELECT DISTINCT day FROM ev), range({BANDS}) AS b, range({ROWS}) AS i, range({COLS}) AS j),
r AS (SELECT day * {DAY} AS t_start, (day + 1) * {DAY} AS t_end, band, y, x, v AS value FROM grid LEFT JOIN summed USING (day, band, y, x))"""


_DAYS: dict[str, list[tuple[int, int]]] = {}


def days(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """The loading information of the raster: days with events, asked for once for each folder."""
    if sf_dir not in _DAYS:
        found = read(spark, sf_dir, "events").select(F.floor(epoch_ms(F.col("ts")) / DAY).alias("day")).distinct().collect()
        _DAYS[sf_dir] = sorted((r.day * DAY, (r.day + 1) * DAY) for r in found)
    return _DAYS[sf_dir]


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data rows with a key and a time of three days in January 2024."""
    o = read(spark, sf_dir, "orders")
    start = F.lit(T0) + F.pmod("o_orderkey", F.lit(30)) * DAY
    return o.select(start.alias("t_start"), (start + 3 * DAY).alias("t_end"), F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderstatus")


BOOKINGS_SQL = f"bookings AS (SELECT {T0} + (o_orderkey % 30) * {DAY} AS t_start, {T0} + (o_orderkey % 30) * {DAY} + {3 * DAY} AS t_end, o_custkey AS user_id, o_orderkey, o_orderstatus FROM orders)"


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping files of one band: each line item is a pixel of a file whose z-index is its line number."""
    li = read(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_partkey") % 5 != 0, F.floor("l_quantity").cast("int"))
    cells = li.select(F.lit(T0).alias("t_start"), F.lit(T0 + DAY).alias("t_end"), F.lit(0).alias("band"), (F.col("l_suppkey") % ROWS).cast("int").alias("y"), (F.col("l_partkey") % COLS).cast("int").alias("x"), (F.col("l_linenumber") * 10_000_000_000 + F.col("l_orderkey")).alias("z_index"), value.alias("value"))
    return cells


def sparse_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that cover a part of the grid, on the first and the third of three days; bands 0 and 1.

    Files of one z-index have one value, so that their order is no matter.
    """
    li = read(spark, sf_dir, "lineitem")
    start = F.lit(T0) + F.pmod("l_orderkey", F.lit(2)) * (2 * DAY)
    y, x = (F.col("l_suppkey") % 5 + 1).cast("int"), (F.col("l_partkey") % 7 * 2).cast("int")
    value = F.when(F.col("l_partkey") % 5 != 0, F.floor("l_quantity").cast("int"))
    return li.select(start.alias("t_start"), (start + DAY).alias("t_end"), (F.col("l_linenumber") % 2).cast("int").alias("band"), y.alias("y"), x.alias("x"), ((F.col("l_linenumber") * 10_000_000_000 + F.col("l_orderkey")) * 100 + F.floor("l_quantity")).alias("z_index"), value.alias("value"))


SPARSE_SQL = f"""cells AS (SELECT {T0} + (l_orderkey % 2) * {2 * DAY} AS t_start, l_linenumber % 2 AS band, l_suppkey % 5 + 1 AS y, l_partkey % 7 * 2 AS x, (l_linenumber * 10000000000 + l_orderkey) * 100 + cast(floor(l_quantity) AS BIGINT) AS z, CASE WHEN l_partkey % 5 <> 0 THEN cast(floor(l_quantity) AS BIGINT) END AS v FROM lineitem),
best AS (SELECT t_start, band, y, x, arg_max(v, z) FILTER (WHERE v IS NOT NULL) AS value FROM cells GROUP BY ALL),
sm AS (SELECT {T0} + d.range * {DAY} AS t_start, {T0} + (d.range + 1) * {DAY} AS t_end, cast(b.range AS BIGINT) AS band, cast(i.range AS BIGINT) AS y, cast(j.range AS BIGINT) AS x, value
 FROM range(3) AS d, range(2) AS b, range({ROWS}) AS i, range({COLS}) AS j LEFT JOIN best ON best.t_start = {T0} + d.range * {DAY} AND band = b.range AND y = i.range AND x = j.range)"""


VECTOR = VectorDescriptor("MultiPoint", {"event_id": "int", "user_id": "int", "event_type": "text", "maybe": "int", "value": "float"})
CLASSES = Measurement("classification", "type", classes=tuple((i, f"class {i}") for i in range(6)))
RASTER = RasterDescriptor("I32", GRID, (0, ROWS - 1, 0, COLS - 1), (Band("a"), Band("b"), Band("c")), step=TimeStep("days", 1), time=(T0, T0 + 30 * DAY))


def context(spark: SparkSession, sf_dir: str) -> Context:
    """All bindings by name."""
    calibrated = (("msg.calibration_offset", -10.0), ("msg.calibration_slope", 0.25), ("msg.channel_number", 4), ("msg.satellite", 1), ("scale", 2), ("offset", 3))
    raster = lambda s: pixels(s, sf_dir)
    classes = lambda s: pixels(s, sf_dir).where("band = 0").withColumn("value", F.pmod("value", F.lit(8)))
    own_days = lambda s: days(s, sf_dir)
    three = [(T0 + k * DAY, T0 + (k + 1) * DAY) for k in range(3)]
    return Context(
        spark,
        {
            "points": (lambda s: points(s, sf_dir), VECTOR),
            "raster": (raster, RASTER),
            "msg": (lambda s: pixels(s, sf_dir).where("band = 0"), RASTER.but(bands=(Band("ir"),), properties=calibrated)),
            "visible": (lambda s: pixels(s, sf_dir).where("band = 0"), RASTER.but(bands=(Band("vis"),), properties=(*calibrated[:2], ("msg.channel_number", 1), ("msg.satellite", 1)))),
            "classes": (classes, RASTER.but(bands=(Band("class", CLASSES),))),
            "bookings": (lambda s: bookings(s, sf_dir), VectorDescriptor("Data", {"user_id": "int", "o_orderkey": "int", "o_orderstatus": "text"}, srs=None)),
            "mosaic": (lambda s: mosaic(s, sf_dir), RASTER.but(bands=(Band("a"),))),
            "sparse": (lambda s: sparse_mosaic(s, sf_dir), RASTER.but(bands=(Band("a"), Band("b")), time=(T0, T0 + 3 * DAY))),
            "nations": (lambda s: read(s, sf_dir, "nation").select(F.lit(MIN_MS).alias("t_start"), F.lit(MAX_MS).alias("t_end"), "n_nationkey", "n_regionkey"), VectorDescriptor("Data", {"n_nationkey": "int", "n_regionkey": "int"}, srs=None)),
            "events": (lambda s: read(s, sf_dir, "events").withColumn("ms", epoch_ms(F.col("ts"))), None),
            "customers": (lambda s: read(s, sf_dir, "customer"), None),
        },
        slices={"raster": own_days, "msg": own_days, "visible": own_days, "classes": own_days, "mosaic": three[:1], "sparse": three},
    )
