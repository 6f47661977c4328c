from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from terrafold import llm

DATA = Path("/root/testdata/sf0.001")


def test_all_are_registered():
    assert {q.split("_")[0] for q in llm.queries()} == {f"op{n}" for n in range(1, 11)}
    assert set(llm.oracle_sql()) <= set(llm.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.sql(llm.oracle_sql()[name])
    got = llm.queries()[name](spark, str(DATA)).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(DATA)).collect()}
    ids = {r.doc_id for r in docs.collect()}
    assert kept < ids and len(kept) > 0.5 * len(ids)
    found = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, str(DATA))
        assert found.columns == docs.columns
    assert {r.doc_id for r in found.collect()} == kept


def test_stages_take_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing names and empty tables, in each stage by itself."""
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "b c d e f g h i j k"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, str(tmp_path))
        rows = out.collect()
        assert name == "bpe" or out.columns == odd.columns
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
        left[name] = sorted(r.doc_id or 0 for r in rows)
        if name not in ("bpe",):
            assert {r.score for r in rows} == {r.spans for r in rows} == {"clash"}
        if name == "secrets":
            assert next(r for r in rows if r.doc_id == 6).text.endswith('[SECRET]"') and next(r for r in rows if r.doc_id == 2).text is None
        if name == "bpe":
            assert all(r.exact for r in rows) and next(r for r in rows if r.doc_id == 6).n_tokens > 10
    assert left["near_dedup"] == [0, 1, 2, 3, 4, 5, 6] and left["decontaminate"] == [0, 2, 3, 4, 5, 5, 6] and left["secrets"] == left["bpe"] == [0, 1, 2, 3, 4, 5, 5, 6]


def test_earlier_stages_are_removed(spark):
    import os

    if not DATA.exists():
        pytest.skip("no test tables")
    out = corpus_pipeline.run(spark, str(DATA))
    folder = os.path.dirname(os.path.dirname(out.inputFiles()[0].removeprefix("file:").replace("///", "/")))
    assert os.listdir(folder) == ["4-bpe"] and out.count() > 0
