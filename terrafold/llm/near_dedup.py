"""Near-duplicate groups by circulant MinHash (operator 10).

Each document is the set of its word shingles, hashed to 64 bits.  Shingles are dealt to 2**32 dimensions, which one
permutation shuffles; a second permutation, circularly shifted by 1, 2, ..., K, gives the K coordinates of a signature.
Equal bands of a signature propose pairs, and each pair is confirmed on the whole sets.

Only components are asked for, so a bucket's members need not all be compared with each other:

1. Documents with equal sets are one node.
2. In each of a few rounds the bucket's first remaining node (the pivot) is compared with the others that are not yet in its
   component, and then leaves the bucket: a star for each bucket, so rows grow as the members.
3. A bucket whose members are all in one component is done.  In the others each node outside the largest component is
   compared with the members of other components whose sets are not too small or too large for it, in blocks bounded in members and
   in shingles, within which one link for each pair of components is enough.

So no pair of one bucket is left out, and a bucket of near copies costs about as many comparisons as it has members.
Links of a later round join components that are known already, so each round works on fewer of them.  Buckets, pivots, hubs,
components and copies may each hold a third of all rows: joins deal the rows of such a key to several tasks (``common.salted_join``).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.engine.workers import importable
from terrafold.llm.common import CACHES, checkpointed, copied, dealt, hot_keys, map_rows, salted_join, table

#: Parameters: bands and rows of a band.  At a similarity of 0.8 a pair shares no band with a chance of 4e-7.
BANDS, ROWS = 28, 4
#: Steps along links before labels jump.
SHORT = 3
#: Rounds of pivots, members and shingles of one side of a block, and the most rows that are broadcast (of two longs each).
ROUNDS, BLOCK, BLOCK_SHINGLES, BROADCAST_ROWS = 2, 256, 1_000_000, 2_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SHIFTS = np.arange(1, BANDS * ROWS + 1, dtype=np.uint32)[:, None]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()
CACHES[__name__] = _hashes.clear


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct shingles of ``width`` words, sorted, as unsigned 64-bit hashes; all words as one if they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # splits at space and 09 to 0D
    if not words:
        return np.empty(0, np.uint64)
    if len(_hashes) > 300_000:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        x ^= h[i : len(h) - n + 1 + i]
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return np.unique(x)


def _permuted(v: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    v ^= v >> np.uint32(16)
    v *= np.uint32(a)
    v ^= v >> np.uint32(15)
    v *= np.uint32(b)
    v ^= v >> np.uint32(16)
    return v


def signature(x: np.ndarray) -> np.ndarray:
    """Minimum of the shifted permutation over the set, for each shift."""
    first = _permuted((x >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    least = np.full(len(_SHIFTS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(first), 4096):
        np.minimum(least, _permuted(first[None, i : i + 4096] - _SHIFTS, 0x21F0AAAD, 0x735A2D97).min(axis=1), out=least)
    return least


def bands(signatures: np.ndarray) -> np.ndarray:
    """One signed 64-bit hash for each band of each signature; the band's number is part of it."""
    s = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    x = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), s.shape[:2]).copy()
    for r in range(ROWS):
        x ^= s[:, :, r]
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x.view(np.int64)


def signed(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key and bands of each document; the last two are null for an empty set."""

    def run(texts: list[str | None]) -> list[list]:
        sets = [shingles(t, width) for t in texts]
        made = bands(np.array([signature(x) for x in sets if len(x)], np.uint32).reshape(-1, BANDS * ROWS)) if any(map(len, sets)) else []
        rows = iter(made)
        return [[len(x) for x in sets], [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], [next(rows) if len(x) else None for x in sets]]

    return map_rows(docs, run, [text], [("n_shingles", pa.int64(), "long"), ("set_key", pa.binary(), "binary"), ("bands", pa.list_(pa.int64()), "array<long>")], ["doc_id"])


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if its counted rows are few enough; else Spark chooses."""
    return F.broadcast(df) if df.count() <= rows else df


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b): the smallest node that can be reached.

    Labels travel along links, and after a few steps are also replaced by the label of the node they name, until none changes.
    """
    links = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hubs = hot_keys(["b"], links)
    sent = dealt(links, hubs, ["b"], F.xxhash64("a"))
    labels = checkpointed(links.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).select(F.col("a").alias("node"), "component"))
    for k in itertools.count():
        known = labels.select("node", F.col("component").alias("was"), F.col("component").alias("own"))
        if k >= SHORT:  # long chains: labels that are not the label of the node they name are replaced
            used = labels.select(F.col("component").alias("node")).distinct().join(labels, "node").where("node != component")
            jumps = checkpointed(used.select(F.col("node").alias("component"), F.col("component").alias("then")))
            named = labels.join(F.broadcast(jumps), "component", "left") if jumps.count() <= BROADCAST_ROWS else salted_join(labels, jumps, ["component"], "left", F.xxhash64("node"))
            known = named.select("node", F.col("component").alias("was"), F.coalesce("then", "component").alias("own"))
        near = sent.join(copied(known.select(F.col("node").alias("b"), "own"), hubs, ["b"]), ["b", "__salt"]).groupBy("a").agg(F.min("own").alias("near"))
        moved = checkpointed(known.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("own", "near").alias("component"), "was"))
        labels = moved.select("node", "component")
        if moved.where("component != was").isEmpty():
            return labels


def merged(labels: DataFrame | None, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) of all nodes linked so far, once ``links`` (a, b) join the components of ``labels``; and the components that changed."""
    new = components(links)
    if labels is None:
        return new, new
    moves = new.select(F.col("node").alias("component"), F.col("component").alias("then"))
    kept = salted_join(labels, moves, ["component"], "left", F.xxhash64("node")).select("node", F.coalesce("then", "component").alias("component"))
    return checkpointed(kept.unionByName(new.join(labels, "node", "left_anti"))), new


def alike(n_a: Column, n_b: Column, both: Column, percent: int) -> Column:
    return 100 * both >= percent * (n_a + n_b - both)


def some(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``sets`` of ``nodes`` (node), as far as a table of few counted rows can tell; a join with the others leaves them out anyway."""
    nodes = checkpointed(nodes.distinct())
    return sets.join(F.broadcast(nodes), "node", "left_semi") if nodes.count() <= BROADCAST_ROWS else sets


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b and other columns; a may be in very many of them, b in one for each band) whose whole sets are similar enough."""
    pairs = checkpointed(pairs)
    pivots = hot_keys(["a"], pairs)
    side = lambda c: some(sets, pairs.select(F.col(c).alias("node"))).select(F.col("node").alias(c), F.col("items").alias(f"items_{c}"))
    a, b = side("a"), side("b")
    both = F.size(F.array_intersect("items_a", "items_b"))
    with_b = dealt(pairs, pivots, ["a"], F.xxhash64("b")).join(b, "b")
    return with_b.join(copied(a, pivots, ["a"]), ["a", "__salt"]).where(alike(F.size("items_a"), F.size("items_b"), both, percent)).select(pairs.columns)


def block_links(rows: pd.DataFrame, percent: int, names: tuple[str, str] = ("a", "b")) -> pd.DataFrame:
    """Links between the outer and the other nodes of a block, one for each pair of components: their nodes, or (x, y) the components.

    Shingles that the block has are numbered, and a product of 0/1 matrices counts all intersections, in
    slices of so many columns that memory stays bounded.
    """
    outer, every = rows[rows["outer"]], rows[~rows["outer"]]
    sets_a, sets_b = list(outer["items"]), list(every["items"])
    if not sets_a or not sets_b:
        return pd.DataFrame({n: [] for n in names}, dtype="int64")
    n_a, n_b = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
    flat_a, flat_b = np.concatenate(sets_a), np.concatenate(sets_b)
    known = np.intersect1d(flat_a, flat_b)
    both, step = np.zeros((len(n_a), len(n_b)), np.float32), 16_384
    for low in range(0, len(known), step):
        part = known[low : low + step]
        dense = []
        for flat, n in ((flat_a, n_a), (flat_b, n_b)):
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[at] == flat
            m = np.zeros((len(n), len(part)), np.float32)
            m[np.repeat(np.arange(len(n)), n)[hit], at[hit]] = 1
            dense.append(m)
        both += dense[0] @ dense[1].T
    same = outer["component"].to_numpy()[:, None] == every["component"].to_numpy()[None, :]
    i, j = np.nonzero((100 * both >= percent * (n_a[:, None] + n_b[None, :] - both)) & ~same)
    out = pd.DataFrame({"a": outer["node"].to_numpy()[i], "b": every["node"].to_numpy()[j], "x": outer["component"].to_numpy()[i], "y": every["component"].to_numpy()[j]})
    return out.drop_duplicates(["x", "y"])[list(names)]


def size_class(n: Column, percent: int) -> Column:
    """A class of set sizes, such that sets that can be similar enough are in one class or in neighbouring ones."""
    return F.floor(F.log(n) / math.log(100 / percent * (1 + 1e-9))).cast("int") if percent < 100 else n.cast("int")


def rest_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) between components in buckets that still hold several of them (members: bucket, node, n, component; cheap to read again).

    None if there is no such bucket.
    """
    importable(members.sparkSession)
    per = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    stats = per.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), F.sum("c").alias("all"), F.max("c").alias("most"))
    stats = checkpointed(stats.where(F.col("all") > F.col("most")).select("bucket", "largest", F.col("all").alias("__n")))
    if stats.isEmpty():
        return None
    node = F.xxhash64("node")
    rows = salted_join(members, stats.drop("__n"), ["bucket"], "inner", node, stats).withColumn("size", size_class(F.col("n"), percent))
    every = checkpointed(rows.select("bucket", "node", "n", "component", "size", (F.col("component") != F.col("largest")).alias("outer")))
    outer = every.where("outer").withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    cell = ["bucket", "size"]
    cut = lambda: F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    cuts = every.groupBy(*cell).agg(cut().alias("js"), F.count(F.lit(1)).alias("n_every")).join(outer.groupBy(*cell).agg(cut().alias("is"), F.count(F.lit(1)).alias("n_outer")), cell)
    cuts = checkpointed(cuts)
    spread = lambda own, n: salted_join(own, cuts.select(*cell, "is", "js"), cell, "inner", node, cuts.select(*cell, F.col(n).alias("__n")))
    deal = lambda n: F.pmod(node, F.col(n)).cast("int")
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = spread(outer, "n_outer").select(*cell, "node", "component", F.lit(True).alias("outer"), deal("is").alias("i"), steps("js").alias("j"))
    asked = spread(every, "n_every").select(*cell, "node", "component", F.lit(False).alias("outer"), steps("is").alias("i"), deal("js").alias("j"))
    blocks = checkpointed(asking.unionByName(asked))
    blocks = blocks.join(some(sets, blocks.select("node")).select("node", "items"), "node")
    return blocks.groupBy(*cell, "i", "j").applyInPandas(lambda x: block_links(x, percent, ("x", "y")), "x long, y long").distinct().select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id integer, text; other columns are left out).

    Documents are linked if 100 * intersection >= percent * union of their sets of ``width``-word shingles.
    component_id is the smallest doc_id that can be reached.  Empty and null texts have an empty set and no link.
    A row whose doc_id is null takes no part in links: its component_id is null and it is kept.  Rows that repeat a doc_id
    are one node with several sets.  An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = checkpointed(signed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), width, text))
    nodes = known.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    nodes = checkpointed(nodes)
    spread = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = checkpointed(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"))
    members = checkpointed(salted_join(spread, shared.select("bucket"), ["bucket"], "inner", F.xxhash64("node"), shared))
    asked = members.select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col(text).alias("__text")).join(bounded(asked), "node")
    sets = map_rows(texts, lambda own: [[shingles(t, width).view(np.int64) for t in own]], ["__text"], [("items", pa.list_(pa.int64()), "array<long>")], ["node"])
    # copies of a set have one node, and that node's text is read, so this has a row for each node
    sets = checkpointed(sets.where(F.size("items") > 0))
    groups, own, node = None, members.withColumn("component", F.col("node")), F.xxhash64("node")
    for _ in range(ROUNDS):
        pivots = own.groupBy("bucket").agg(F.min(F.struct("node", "n", "component")).alias("p"), F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("__n")).where("low < high")
        pivots = checkpointed(pivots.select("bucket", "p", "__n"))
        own = checkpointed(salted_join(own, pivots.select("bucket", "p"), ["bucket"], "inner", node, pivots).where("node != p.node"))
        fits = (100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")) & (F.col("component") != F.col("p.component"))
        pairs = own.where(fits).select(F.col("p.node").alias("a"), F.col("node").alias("b"), F.col("p.component").alias("x"), F.col("component").alias("y")).distinct()
        groups, moves = merged(groups, confirmed(pairs, sets, percent).select(F.col("x").alias("a"), F.col("y").alias("b")))
        moves = moves.select(F.col("node").alias("component"), F.col("component").alias("then"))
        own = checkpointed(salted_join(own.drop("p"), moves, ["component"], "left", node).withColumn("component", F.coalesce("then", "component")).drop("then"))
    rest = rest_links(own, sets, percent)
    if rest is not None or groups is None:
        groups, _ = merged(groups, rest if rest is not None else own.select(F.col("node").alias("a"), F.col("node").alias("b")))
    named = nodes.select("set_key", "node").join(groups, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    placed = salted_join(known.select("doc_id", "n_shingles", "set_key"), named, ["set_key"], "left", F.xxhash64("doc_id", F.monotonically_increasing_id()), nodes.select("set_key", F.col("copies").alias("__n")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return placed.select(
        F.col("doc_id").cast(kind), "n_shingles", component.cast(kind).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept: one for each group of near copies, with all columns.

    Of rows that repeat a doc_id the least by text stays.  Rows without doc_id all stay.
    """
    found = checkpointed(near_duplicates(docs, width, percent).select("doc_id", "kept"))
    gone = bounded(found.where(~F.col("kept")).select("doc_id").distinct())
    rest = docs.join(gone, "doc_id", "left_anti")
    again = checkpointed(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return rest
    columns = [F.col("text"), *[F.col(c) for c in docs.columns if c not in ("text", "doc_id")]]
    one = rest.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("row")).select("doc_id", "row.*")
    return rest.join(again, "doc_id", "left_anti").unionByName(one.select(docs.columns))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents, by shingles of two words and a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM d),
n AS (SELECT doc_id, s, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n_a, b.n AS n_b, len(list_intersect(a.s, b.s)) AS n_both
      FROM n AS a JOIN n AS b ON a.doc_id < b.doc_id AND a.n > 0 AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM p WHERE 100 * n_both >= 80 * (n_a + n_b - n_both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, cast(n AS BIGINT) AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m USING (doc_id)
"""
