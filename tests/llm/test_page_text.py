from __future__ import annotations

import html
import random
import re
from pathlib import Path

import numpy as np
import pytest

from terrafold.llm.page_text import blocks, extract, labeller, main_text, training_page

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li><li><a href="/y">About us</a></li></ul></nav>
<div class="ad">Buy now &amp; save.</div><article><h1>Stone &lt;river&gt;</h1><p><b>First   line<br>goes on.<br><p>Second &eacute;&#233; one.</p><ul><li>a point<li>another</ul></article>
<section class="comments"><p>I disagree.</p></section><form><label>Mail</label><input></form><footer>&copy; someone</footer></body></html>"""


def test_blocks():
    assert [b.text for b in blocks(PAGE)] == ["Home", "About us", "Buy now & save.", "Stone <river>", "First line goes on.", "Second éé one.", "a point", "another", "I disagree.", "Mail", "© someone"]


def test_main_text():
    assert extract(labeller(), [PAGE]) == ["Stone <river>\nFirst line goes on.\nSecond éé one.\na point\nanother"]


def test_held_out_accuracy():
    r, right, n = random.Random(4242), 0, 0
    pages = [training_page(r) for _ in range(200)]
    own = [blocks(p) for p, _ in pages]
    for (_, truth), labels in zip(pages, labeller().label(own), strict=True):
        assert len(truth) == len(labels)
        n += len(truth)
        right += sum(bool(a) == b for a, b in zip(labels, truth, strict=True))
    assert right >= 0.98 * n


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "plain words", "<!-- open", "<script>never closed", "</p></div>", "<p>" * 3000, "<div>" * 3000 + "x", "&#xD800; &nosuch; &amp", "<a <b> c='>'>x</a>", "\x00<p>\x00</p>"])
def test_broken_pages(page):
    assert isinstance(extract(labeller(), [page])[0], str)


def test_columns(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, "x"), (None, "u", "", "x")], "page_id long, url string, html string, text string")
    rows = {r.page_id: r.text for r in main_text(df).collect()}
    assert rows[1].startswith("Stone") and rows[2] == rows[None] == ""
    assert main_text(df.limit(0)).count() == 0


DATA = Path("/root/testdata/sf0.01/pages.parquet")


def labelled(page):
    """The main text of a page of the test tables: their main text is what stands in <article>, as a look at them shows."""
    inner = re.sub(r"</?(p|h1)\b[^>]*>", "\x01", re.sub(r"<br\s*/?>", " ", re.search(r"<article>(.*?)</article>", page, re.S)[1]))
    own = (" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]*>", "", inner).split("\x01"))
    return "\n".join(x for x in own if x)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_pages_of_the_test_tables():
    import pyarrow.parquet as pq

    pages = pq.read_table(DATA)["html"].to_pylist()
    right = [a == labelled(p) for a, p in zip(extract(labeller(), pages), pages, strict=True)]
    assert sum(right) >= 0.99 * len(right)


def test_elements_that_stay_open_at_any_depth():
    inner = "<span>" * 500
    page = f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Stone</h1><p>Words of the river {inner} go on and on.</p></article><div class='footer'>&copy; someone</div></body></html>"
    own = blocks(page)
    assert own[-1].path == blocks("<html><body><div class='footer'>x</div></body></html>")[0].path
    assert extract(labeller(), [page])[0].endswith("go on and on.")
    nested = blocks("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul><table><tr><td>f<td>g<tr><td>h</table><p>i<div>j</div>k")
    assert [b.text for b in nested] == list("abcdefghijk")
    assert nested[1].path == nested[2].path and nested[0].path == nested[4].path and nested[5].path == nested[7].path


def test_long_pages_are_read_in_parts():
    page, n = training_page(random.Random(9)), 3_000
    long = "<html><body><nav><ul>" + "<li><a href='/'>x y</a></li>" * 50 + "</ul></nav><article>" + "<p>Some words of a long article, and more.</p>" * n + "</article><footer>end</footer></body></html>"
    model, own = labeller(), [blocks(long), blocks(page[0])]
    whole = model.scores([own[0]], most=1 << 20)
    assert np.allclose(whole, model.scores([own[0]], most=97), atol=1e-4)
    both = model.scores(own, most=64)
    assert np.allclose(both[: len(own[1]), 1], model.scores([own[1]])[:, 0], atol=1e-4) and np.allclose(both[:, 0], whole[:, 0], atol=1e-4)
    assert extract(model, [long])[0].count("\n") == n - 1


def test_a_very_long_block_and_very_many_open_elements():
    word = "stone river " * 200_000
    text = extract(labeller(), [f"<article><h1>Title of it</h1><p>{word}</p></article>"])[0]
    assert len(text) > 2_000_000
    assert len(blocks("<div><span>x" * 50_000)) == 50_000
