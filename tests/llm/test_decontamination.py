from __future__ import annotations

import random
import re

import pytest

from terrafold.llm.decontamination import clean, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in enumerate(texts, 1):
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, docs, seed):
    r = random.Random(seed)
    vocabulary = ["w" + c for c in "abcdefgh"] + ["Ünï", "é", "THE", "9"]
    prose = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ",", ".\n"]) for _ in range(n))
    items = [(i, prose(r.choice([1, 3, 9, 10, 11, 30]))) for i in range(8)] + [(99, "..."), (None, "wa wb")]
    texts = [prose(r.randint(0, 60)) for _ in range(30)]
    for k in range(0, 30, 3):
        texts[k] += " " + r.choice(items)[1].upper() + " " + prose(5)
    got = decontaminate(docs(texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(texts, [x for x in items if x[0] is not None])
    assert {g.doc_id: (g.n_words, g.n_hit, g["items"]) for g in got} == want
    assert all(g.contaminated == (g.n_hit > 0) and g.n_items == len(g["items"]) for g in got)


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "b c d e f g h i j k", "t"), (2, None, "t"), (3, "", "t")], "item_id long, text string, window string")
    got = {r.doc_id: r for r in decontaminate(odd, items).collect()}
    assert got[1].n_hit == 10 and got[2].n_words == got[3].n_words == got[4].n_words == 0 and got[5].n_words == 60_000 and got[None].n_words == 3
    assert sorted((r.doc_id or 0) for r in clean(odd, items).collect()) == [0, 2, 3, 4, 5, 5, 6]
    assert decontaminate(odd.limit(0), items).count() == 0
    assert {r.n_hit for r in decontaminate(odd, items.limit(0)).collect()} == {0}
    assert clean(odd, items.limit(0)).columns == odd.columns


def test_rows_that_repeat_give_a_row_each_as_in_sql(spark):
    import duckdb

    from terrafold.llm import decontamination

    item = "b c d e f g h i j k"
    rows = [(1, "a " + item), (1, "a " + item), (2, "a " + item), (None, item), (None, item), (1, "x " + item + " " + item), (3, None), (3, None)]
    items = [(7, item), (10, item + " z"), (9, "q")]
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    own = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in got.collect()))
    assert own == sorted([(1, 11, 10, ["10", "7"])] * 2 + [(2, 11, 10, ["10", "7"])] + [(0, 10, 10, ["10", "7"])] * 2 + [(1, 21, 20, ["10", "7"]), (3, 0, 0, []), (3, 0, 0, [])])
    db = duckdb.connect()
    for name, own_rows, columns in (("documents", rows, "doc_id BIGINT, text VARCHAR"), ("benchmark", items, "item_id BIGINT, text VARCHAR")):
        db.execute(f"CREATE TABLE {name} ({columns})")
        db.executemany(f"INSERT INTO {name} VALUES (?, ?)", own_rows)
    assert sorted((r[0] or 0, r[1], r[2], r[3]) for r in db.sql(decontamination.OP1_SQL).fetchall()) == sorted((a, b, c, len(d)) for a, b, c, d in own)


def test_large_tables_of_items_are_not_broadcast(spark, docs, monkeypatch):
    from terrafold.llm import common, decontamination

    r = random.Random(11)
    prose = lambda n: " ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(n))
    items = [(i, prose(14)) for i in range(6)]
    texts = [prose(20) + " " + items[k % 6][1] for k in range(40)]
    own = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontaminate(docs(texts), own).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert sorted(map(tuple, decontaminate(docs(texts), own).collect())) == want
    monkeypatch.setattr(common, "HOT_KEYS", 1)
    assert sorted(map(tuple, decontaminate(docs(texts), own).collect())) == want
