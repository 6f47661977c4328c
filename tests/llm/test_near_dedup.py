from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
import pytest

from terrafold.llm import near_dedup
from terrafold.llm.near_dedup import block_links, deduplicated, near_duplicates, rest_links, shingles, signature


def sets(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(texts, width):
    own, parent = [sets(t, width) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) + 1 for i in range(len(texts))], [len(s) for s in own]


def family(r, n, words=80):
    """Near copies of one text, some of which are linked only through it or through each other."""
    base = [f"w{r.randint(0, 500)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        own = list(base)
        for _ in range(r.randint(0, 9)):
            own[r.randrange(words)] = f"x{r.randint(0, 10**6)}"
        out.append(r.choice([" ", "\n"]).join(own) if r.random() < 0.8 else out[-1].upper())
    return out


@pytest.mark.parametrize(("seed", "width"), [(0, 2), (1, 2), (2, 5)])
def test_against_brute_force(docs, seed, width):
    r = random.Random(seed)
    texts = family(r, 60) + family(r, 20, 300) + [" ".join(f"q{r.randint(0, 9)}" for _ in range(r.randint(0, 8))) for _ in range(40)] + [None, "", " ", "one", "ONE", "two words", "two  words"]
    r.shuffle(texts)
    got = near_duplicates(docs(texts), width).orderBy("doc_id").collect()
    want, n = brute(texts, width)
    assert [g.component_id for g in got] == want and [g.n_shingles for g in got] == n and all(g.kept == (g.doc_id == g.component_id) for g in got)


def test_blocks_find_what_pivots_leave(docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "confirmed", lambda *a: pytest.fail("no pivots here"))
    r = random.Random(7)
    texts = family(r, 50)
    rows = [(i, len(sets(t, 2)), i) for i, t in enumerate(texts)]
    spark = docs(["x"]).sparkSession
    members = spark.createDataFrame([(1, *x) for x in rows], "bucket long, node long, n long, component long")
    own = spark.createDataFrame([(i, shingles(t, 2).view(np.int64).tolist()) for i, t in enumerate(texts)], "node long, items array<long>")
    links = {tuple(sorted((x.a, x.b))) for x in rest_links(members, own, 80).collect()}
    true = {(j, i) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if 100 * len(sets(a, 2) & sets(b, 2)) >= 80 * len(sets(a, 2) | sets(b, 2))}
    assert links == true


def test_block_links_by_slices():
    x = [np.arange(k, k + 40_000) for k in (0, 100, 39_000)]
    rows = pd.DataFrame({"node": [1, 2, 3, 1, 2, 3], "component": [1, 2, 3, 1, 2, 3], "outer": [True] * 3 + [False] * 3, "items": x + x})
    assert sorted(map(tuple, block_links(rows, 80).to_numpy().tolist())) == [(1, 2), (2, 1)]


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    x = np.unique(r.integers(0, 2**63, 2000).astype(np.uint64))
    a, b = signature(x[:1800]), signature(x[200:])
    assert abs((a == b).mean() - 1600 / 2000) < 0.12


def test_odd_rows(odd):
    got = near_duplicates(odd, 2).collect()
    assert len(got) == 8
    by = {g.doc_id: g for g in got}
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and by[2].kept and by[None].component_id is None and by[None].kept and by[5].n_shingles == 3
    assert near_duplicates(odd.limit(0)).count() == 0
    kept = deduplicated(odd)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6] and kept.columns == odd.columns


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.component for r in near_dedup.components(chain).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[102] == 100
