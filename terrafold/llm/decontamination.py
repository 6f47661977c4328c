"""Benchmark decontamination by winnowing (operator 1), with DataFrame operations only.

A window is 10 consecutive words of an item.  Its fingerprint is the least hash of the k-word grams inside, the one that
winnowing keeps for it, so documents and items that share a window share its fingerprint whatever surrounds it:
no window can be missed.  The fingerprints of all documents are joined with those of the items; windows of documents
that were hit are then compared word by word, which extends each hit to the words that it covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import ascii_lower, checkpointed, salted_join, table, text_or_empty

#: Parameters: words of a window and of a gram, and the most rows and bytes of a table that is broadcast.
WINDOW, GRAM, BROADCAST_ROWS, BROADCAST_BYTES = 10, 5, 500_000, 64 << 20
#: Fixed value: what stands between words, once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(ascii_lower(text_or_empty(text)), BETWEEN), "")


def fingerprints(own: Column, length: int) -> Column:
    """The fingerprint of each window of ``length`` words, in order; none if there are fewer words.

    An array around an array names it inside the lambda that follows, so that it is made once.
    """
    gram = min(GRAM, length)
    inside = length - gram + 1
    named = lambda made, use: F.flatten(F.transform(F.array(made), use))
    run = lambda a, x, i, n: [x, *[F.get(a, i + k) for k in range(1, n)]]  # noqa: E731  n neighbours, this one first
    grams = named(F.transform(own, lambda w: F.xxhash64(w)), lambda h: F.transform(h, lambda x, i: F.xxhash64(F.lit(length), *run(h, x, i, gram))))
    starts = F.size(own) - (length - 1)
    if inside > 1:
        made = named(grams, lambda g: F.transform(F.slice(g, 1, starts), lambda x, i: F.least(*run(g, x, i, inside))))
    else:
        made = F.slice(grams, 1, starts)
    return F.when(F.size(own) >= length, made).otherwise(F.array().cast("array<bigint>"))


def windows(own: Column, length: int) -> Column:
    """start (from 0), length, fingerprint and words of each window."""
    return F.transform(fingerprints(own, length), lambda f, i: F.struct(i.alias("start"), F.lit(length).alias("length"), f.alias("fingerprint"), F.array_join(F.slice(own, i + 1, length), " ").alias("window")))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """length, fingerprint, window, item (a string): a row for each distinct window and each item that has it.

    An item of fewer than 10 words, but not none, is one window.  Items without words or id are left out.
    """
    own = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words().alias("w")).where(F.size("w") > 0)
    parts = [own.where(F.size("w") >= WINDOW).select("item", F.explode(windows(F.col("w"), WINDOW)).alias("x"))]
    parts += [own.where(F.size("w") == n).select("item", F.explode(windows(F.col("w"), n)).alias("x")) for n in range(1, WINDOW)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.select("x.length", "x.fingerprint", "x.window", "item").distinct()


def text_key() -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), F.col("text")).alias("k2")]


def sized_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with ``small`` (checkpointed): broadcast if its counted rows and bytes are few, else with hot keys of ``big`` dealt to several tasks."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in small.dtypes if t == "string"] + [8 * F.size(c) * 4 for c, t in small.dtypes if t == "array<string>"]
    rows, size = small.agg(F.count(F.lit(1)), F.sum(sum(wide, F.lit(16 * len(small.columns))))).first()
    if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), keys, how)
    return salted_join(checkpointed(big), small, keys, how)


def scan(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each row of ``docs``: doc_id, k1, k2, n_words; a row for each text with a window of an item: k1, k2, n_hit, items).

    What a text hits depends on the text alone, so it is found once for all rows that share it.
    """
    pairs = checkpointed(item_windows(benchmark))
    known = checkpointed(pairs.select("length", "fingerprint", "window").distinct())
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # ten numbers at most
    key = ["k1", "k2"]
    base = docs.select("doc_id", *text_key(), words().alias("w"))
    if not lengths:
        none = base.select(*key, F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")).limit(0)
        return base.select("doc_id", *key, F.size("w").cast("long").alias("n_words")), none
    # the first fingerprint stands for the row itself; of the others only those that an item has go on
    own = F.array_distinct(F.concat(*[fingerprints(F.col("w"), n) for n in lengths]))
    spread = base.select("doc_id", *key, F.size("w").cast("long").alias("n_words"), F.posexplode_outer(own).alias("i", "fingerprint"))
    marks = checkpointed(known.select("fingerprint").distinct().withColumn("hit", F.lit(True)))
    first = F.coalesce(F.col("i") == 0, F.lit(True))
    seen = checkpointed(sized_join(spread, marks, ["fingerprint"], "left").where(first | F.col("hit")).select("doc_id", *key, "n_words", first.alias("first"), F.coalesce("hit", F.lit(False)).alias("hit")))
    asked = checkpointed(seen.where("hit").select(*key).distinct())
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    again = docs.select(*text_key(), "text").join(asked, key, "left_semi").select(*key, words().alias("w"))
    hits = again.select(*key, F.explode(F.concat(*[windows(F.col("w"), n) for n in lengths])).alias("x")).select(*key, "x.*")
    hits = checkpointed(sized_join(hits, known, ["length", "fingerprint", "window"]).select(*key, "start", "length", "window").distinct())
    # spans in order of their start: each adds the words beyond the end of those before
    spans = F.array_sort(F.collect_set(F.struct("start", "length")))
    add = lambda acc, s: F.struct(F.greatest(acc["end"], s["start"] + s["length"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).alias("n"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), add, lambda acc: acc["n"].cast("long"))
    counts = hits.groupBy(*key).agg(spans.alias("spans")).select(*key, covered.alias("n_hit"))
    items = sized_join(hits.select(*key, "length", "window").distinct(), pairs.select("length", "window", "item"), ["length", "window"]).select(*key, "item").distinct()
    items = items.groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    return seen.where("first").select("doc_id", *key, "n_words"), checkpointed(counts.join(items, key))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted), contaminated for each row of ``docs`` (doc_id, text; other columns are left out).

    n_hit counts words inside any window that an item has as well; items are those whose windows occur.  Null and empty
    texts have no words.  Rows that repeat, and null doc_ids, give a row each.  Very long texts are compared as a whole: memory grows with
    the words of one text.  Tables without rows: no documents give no rows, no items give no hits.
    """
    rows, found = scan(docs, benchmark)
    joined = sized_join(rows, found, ["k1", "k2"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that share no window with an item, with all columns."""
    found = scan(docs, benchmark)[1].select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    k1, k2 = text_key()
    return docs.join(found, (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie inside a window of a benchmark item, and the items."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT rid, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, n, i FROM m)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, cast(item_id AS varchar) AS s FROM m) GROUP BY rid)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
