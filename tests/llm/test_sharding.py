from __future__ import annotations

import zlib

import pytest

from terrafold.llm.sharding import shard


def check(rows, texts, shards=8):
    assert len(rows) == len(texts)
    sizes = [len((t or "").encode()) + 1 for t in texts]
    total, by = sum(sizes), {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    if total > 50 * max(sizes):
        assert len(by) == shards and all(abs(sum(r.size for r in own) - total / shards) <= max(sizes) for own in by.values())


@pytest.mark.parametrize("ranges", [4, 256])
def test_near_equal_bytes(docs, ranges):
    texts = [("text %d " % (i % 50)) * (i % 17 + 1) for i in range(800)] + ["hot group of copies"] * 400 + [None, ""]
    rows = shard(docs(texts), ranges=ranges, sample=300).collect()
    check(rows, texts)
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id - 1] or "").encode()) and r.size == len((texts[r.doc_id - 1] or "").encode()) + 1 for r in rows)
    small = [{r.shard for r in rows if texts[r.doc_id - 1] == f"text {k} " * n} for k in range(50) for n in range(1, 18)]
    assert sum(len(s) > 1 for s in small) <= 7  # groups part only where a boundary falls


def test_odd_rows(odd, docs):
    rows = shard(odd).collect()
    assert len(rows) == 8 and {r.size for r in rows if r.doc_id in (2, 3)} == {1}
    assert shard(odd.limit(0)).count() == 0
    check(shard(docs(["same"] * 500)).collect(), ["same"] * 500)


def test_splitters_of_several_levels(spark):
    from pyspark.sql import functions as F

    from terrafold.llm.sharding import range_of

    for n in (0, 1, 31, 32, 33, 1024, 1025, 2500):
        cuts = [(3 * k, 0, 0) for k in range(n)]
        keys = spark.range(-2, 3 * n + 3).select(F.col("id").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("k3"))
        assert all(r.part == min(n, max(0, r.k1 // 3 + 1)) for r in keys.select("k1", range_of(cuts).alias("part")).collect())


def test_rows_that_repeat_one_document_are_cut(spark):
    from pyspark.sql import functions as F

    from terrafold.llm import sharding

    df = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    keyed = sharding.checkpointed(sharding.records(df))
    cuts = sharding.splitters(keyed, 27_000, 16, 512)
    assert len(cuts) == 15 and len(set(cuts)) == 15
    assert max(r["count"] for r in keyed.groupBy(sharding.range_of(cuts)).count().collect()) < 600
    check(shard(df).collect(), ["the same"] * 3000)
