from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import quality_model, quality_rules


def brute(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    at = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(at)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_measures_against_brute_force(spark, docs):
    r = random.Random(3)
    texts = [None, "", " \n ", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 30]
    for _ in range(60):
        line = " ".join(r.choice(["aa", "b", "cé", "#d", "||", "e<f>"]) for _ in range(r.randint(1, 12)))
        texts.append("\n".join(r.choice([line, line.upper(), "", "z"]) for _ in range(r.randint(1, 9))))
    got = quality_rules.quality_rules(docs(texts), labels(spark, [(1, 1, 0)]).limit(0)).orderBy("doc_id").collect()
    assert [(g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got] == [brute(t) for t in texts]
    assert [g.kept for g in got] == [not (g.n_words < 20 or 100 * g.n_repeat_words > 30 * g.n_words) for g in got]


def test_bounds_are_exact():
    assert quality_rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert quality_rules.upper_bound(5, 5, 0.05) == 1.0
    p = quality_rules.upper_bound(3, 50, 0.01)
    from math import comb

    assert sum(comb(50, k) * p**k * (1 - p) ** (50 - k) for k in range(4)) == pytest.approx(0.01, abs=1e-9)


def test_thresholds_reject_junk_and_few_good_texts(spark, docs):
    r = random.Random(5)
    good = [" ".join(r.choice(["stone", "river", "of", "the", "house", "market"]) + str(r.randint(0, 999)) for _ in range(60)) for _ in range(1500)]
    bad = [" ".join(w + "###" for w in g.split()) for g in good[:50]]
    df = docs(good + bad)
    got = quality_rules.quality_rules(df, labels(spark, [(i + 1, 1, 0) for i in range(1200)])).collect()
    kept = {g.doc_id: g.kept for g in got}
    assert not any(kept[1501 + k] for k in range(50)) and sum(not kept[k + 1] for k in range(1500)) <= 15


def test_odd_rows(spark, odd):
    none = labels(spark, [(1, 1, 0), (None, 0, 0), (2, None, 0)])
    rows = quality_rules.quality_rules(odd, none).collect()
    assert len(rows) == 8 and not next(r for r in rows if r.doc_id == 2).kept
    assert quality_rules.quality_rules(odd.limit(0), none).count() == 0
    model = quality_model.train(odd, none)
    scored = quality_model.score(odd, model).collect()
    assert len(scored) == 8 and all(0 <= r.score <= 1 for r in scored)
    assert quality_model.score(odd.limit(0), quality_model.train(odd, none.limit(0)), ["doc_id"]).count() == 0


def test_model_learns_from_rows_that_are_not_held_out(spark, docs):
    r = random.Random(1)
    texts, quality = [], []
    for _ in range(600):
        bad = r.random() < 0.4
        words = [r.choice(["stone", "river", "of", "the"]) + str(r.randint(0, 99)) for _ in range(r.randint(5, 80))]
        texts.append(" ".join(w + "***" if bad else w for w in words))
        quality.append(int(not bad))
    df, own = docs(texts), labels(spark, [(i + 1, q, 0) for i, q in enumerate(quality)])
    model = quality_model.train(df, own)
    rows = quality_model.score(df, model, ["doc_id"]).withColumn("h", quality_model.held_out()).collect()
    assert all(x.h == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in rows)
    test = [(x.score >= 0.3) == bool(quality[x.doc_id - 1]) for x in rows if x.h]
    assert len(test) > 50 and np.mean(test) > 0.97
    flipped = own.withColumn("quality", F.when(quality_model.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_model.train(df, flipped)
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables, strict=True))  # held-out labels change nothing


def test_one_class():
    model = quality_model.fit(np.random.default_rng(0).random((50, 20)), np.ones(50))
    assert model.score(np.zeros((1, 20)))[0] > 0.9


def test_thresholds_count_every_labelled_document(spark):
    n = 30_000
    share = F.when((F.col("id") >= 24_000) & (F.col("id") % 2 == 0), 0.9).otherwise(0.0)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("de").alias("stratum"), F.lit(50).alias("n_words"), F.lit(0).alias("n_repeat_words"), *[share.alias(r) for r in quality_rules.RULES])
    own = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    found = quality_rules.labelled(docs, own)
    assert found.count() == n and found.where("symbol_share > 0").count() == 3000


def test_rare_languages_get_cutoffs_from_all_labels(spark, docs):
    r = random.Random(7)
    text = lambda: " ".join(r.choice(["stone", "river", "of", "the", "house", "market"]) + str(r.randint(0, 999)) for _ in range(24))
    df = docs([text() for _ in range(800)] + [" ".join(w + "###" for w in text().split()) for _ in range(5)]).withColumn("lang", F.lit("fr"))
    many = spark.range(1_000, 31_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(w), F.col("id").cast("string")) for w in "a b c d e f g h i j k l m n o p q r s t u v".split()]).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    own = labels(spark, [(i + 1, 1, 0) for i in range(800)]).unionByName(many.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    kept = {g.doc_id: g.kept for g in quality_rules.quality_rules(df.unionByName(many), own).where("doc_id < 1000").collect()}
    assert sum(kept[k + 1] for k in range(800)) >= 792 and not any(kept[801 + k] for k in range(5))


def test_more_strata_than_a_thousand(spark):
    few = spark.range(1, 1200).select(F.concat(F.lit("l"), "id").alias("stratum"))
    df = few.unionByName(spark.range(3000).select(F.lit("zz").alias("stratum"))).select("stratum", F.lit(1).alias("quality"), F.lit(50).alias("n_words"), F.lit(0).alias("n_repeat_words"), *[F.lit(0.0).alias(r) for r in quality_rules.RULES])
    cut = quality_rules.calibrate(df)
    assert {s for s, _ in cut} == {"zz"}


@pytest.mark.parametrize("n", [400, 600, 1000, 5000, 20_000])
def test_certified_is_the_bound(n):
    for bad in range(0, n // 80):
        assert quality_rules.certified(bad, n, 0.002, 0.01) == (quality_rules.upper_bound(bad, n, 0.002) <= 0.01)


def test_scores_are_sums_of_looked_up_values(docs):
    """Against a plain loop over tables, bins and pairs."""
    r = np.random.default_rng(2)
    texts = [" ".join(r.choice(["stone", "River!", "of", "###", "9"], r.integers(0, 60))) for _ in range(300)]
    x = np.array([quality_model.features(t) for t in texts])
    model = quality_model.fit(x, (x[:, 5] < 0.2).astype(float))

    def plain(own):
        total = model.start
        for j in range(len(own)):
            total += model.tables[j][sum(own[j] >= c for c in model.cuts[j])]
        for (i, j), values in zip(model.pairs, model.pair_tables, strict=True):
            total += values[sum(own[i] >= c for c in model.pair_cuts[i])][sum(own[j] >= c for c in model.pair_cuts[j])]
        return 1 / (1 + np.exp(-total))

    got = {g.doc_id: g.score for g in quality_model.score(docs(texts), model).collect()}
    assert np.allclose([got[i + 1] for i in range(len(texts))], [plain(own) for own in x])


def test_repeated_rows_of_the_sample_count_once(spark, docs):
    texts = ["stone river of the house"] * 3 + ["### $$$ ***"]
    once = docs(texts)
    many = once.unionByName(once.where("doc_id = 1").crossJoin(spark.range(500)).drop("id"))
    own = labels(spark, [(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 0, 0)])
    a, b = quality_model.train(once, own), quality_model.train(many, own)
    assert a.start == b.start and all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True))
