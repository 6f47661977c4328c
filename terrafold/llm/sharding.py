"""Sharding by sampled splitters (operator 7), with DataFrame operations only.

Records get a key of three hashes: of the text, of the document, and of the row's place in the table.  A size-weighted
sample of keys gives the splitters; they cut the key space into ranges of about equal size, more of them for more rows.  A range that
is still overfull is cut again at splitters sampled within it; the later parts of the key let even a group of equal texts, or
of rows that repeat one document, be cut.  Cumulated sizes of the ranges and running sizes within each range place each record exactly.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.llm.common import checkpointed, table

#: Parameters: ranges at least, rows of a range, keys that are sampled for each range on average, and the size in mean ranges from which one is cut again.
RANGES, RANGE_ROWS, SAMPLED, OVERFULL = 256, 4_000_000, 64, 2.0
#: Parameter: splitters that a key is compared with at once.
STEP = 32


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key of each document, none of the text itself.  To be written before it is used, as k3 numbers rows."""
    text = F.col("text").cast("binary")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"),
        F.xxhash64("text").alias("k1"),
        F.xxhash64(F.lit("doc"), F.col("doc_id")).alias("k2"),
        F.xxhash64(F.lit("row"), F.monotonically_increasing_id()).alias("k3"),
    )


KEY = ["k1", "k2", "k3"]


def splitters(keyed: DataFrame, total: int, ranges: int, sample: int) -> list[tuple[int, ...]]:
    """At most ``ranges`` - 1 keys at equal steps of size; ``sample`` keys on average come to the driver."""
    # each row is drawn with a chance in proportion to its size; a row larger than a step is always in
    chance = F.least(F.lit(1.0), F.col("size") * (sample / max(1, total)))
    drawn = keyed.withColumn("w", F.col("size") / chance).where(F.pmod(F.xxhash64("k2", "k1", "k3"), F.lit(1 << 30)) < chance * (1 << 30))
    rows = drawn.select(*KEY, "w").toPandas().sort_values(KEY, kind="stable")
    step, out = rows["w"].sum() / ranges, []
    for *key, reached in zip(*[rows[k].tolist() for k in KEY], rows["w"].cumsum().tolist(), strict=True):
        if reached >= step * (len(out) + 1) and len(out) < ranges - 1:
            out.append(tuple(key))
    return out


def range_of(cuts: list[tuple[int, ...]]) -> Column:
    """How many splitters a key has reached: first among every so many of them, then among those between, level by level."""
    fixed = lambda own: F.from_json(F.lit(json.dumps([dict(zip(KEY, c, strict=True)) for c in own])), "array<struct<k1:bigint,k2:bigint,k3:bigint>>")  # noqa: E731  one literal

    def nearer(at: Column, step: int) -> Column:
        """``at`` and the splitters after it that a key reached, counted in steps.  An array around ``at`` names it, so that it is made once."""
        near = lambda a: F.slice(fixed(cuts[step - 1 :: step]), (a / step).cast("int") + 1, F.lit(STEP))
        return F.element_at(F.transform(F.array(at), lambda a: a + step * F.size(F.filter(near(a), lambda c: c <= F.struct(*KEY)))), 1)

    step, at = 1, F.lit(0)
    while step * STEP < len(cuts):
        step *= STEP
    while step and cuts:
        at, step = nearer(at, step), step // STEP
    return at


def shard(docs: DataFrame, shards: int = 8, ranges: int | None = None, sample: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null) for each row of ``docs``.

    docs needs doc_id and text; other columns are left out.  ranges: by default one for each RANGE_ROWS rows, and RANGES at least;
    sample: by default SAMPLED keys for each.  Sizes of shards differ by less than the largest record.
    Equal texts are neighbours and share a shard unless a boundary falls among them: the law ``bytes`` cuts even the largest group, as
    otherwise a group of a third of all bytes would fill one shard beyond its share.  Rows that repeat a document wholly are kept, in
    neighbouring slots; the row's own hash cuts them if they overfill a range.  Very long texts are records like others, of their size.
    Null texts have size 1 and the checksum of an empty text.  Null doc_ids are keys like others.  An empty table gives no rows.
    """
    keyed = checkpointed(records(docs))  # a few numbers for each row, so that the texts are read once
    rows = keyed.count()
    ranges = ranges or max(RANGES, -(-rows // RANGE_ROWS))
    sample = sample or SAMPLED * ranges
    total = keyed.agg(F.sum("size")).first()[0] or 0
    cuts = splitters(keyed, total, ranges, sample)
    ranged = keyed.withColumn("part", range_of(cuts))
    full = [r["part"] for r in ranged.groupBy("part").agg(F.sum("size").alias("s")).where(F.col("s") > OVERFULL * total / ranges).select("part").collect()]
    if full:
        again = splitters(ranged.where(F.col("part").isin(full)), total, 2 * ranges, 2 * sample)
        ranged = keyed.withColumn("part", range_of(sorted({*cuts, *again})))
    by_range = ranged.groupBy("part").agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are ranges
    offsets = by_range.select("part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("size_0"), F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("row_0"))
    order = Window.partitionBy("part").orderBy(*KEY)
    placed = checkpointed(  # else the windows would run again for the first rows
        ranged.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("row", F.row_number().over(order) - 1)
        .join(F.broadcast(offsets), "part")  # at most 3 * ranges rows
        .withColumn("row", F.col("row") + F.col("row_0"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor((F.col("size_0") + F.col("before") + F.col("size") / 2) * shards / F.lit(float(max(1, total))))).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "row")
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("row_1"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row for each shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("row_1")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards of near equal bytes."""
    return shard(table(spark, sf_dir, "documents"))
