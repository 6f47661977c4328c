from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrafold.llm import bpe
from terrafold.llm.token_counts import document_lengths, write_token_files

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60) | st.text("ab AB's\n\t<|endoftx>é日😀1½", max_size=80))
def test_ids_and_texts_are_those_of_the_library(text):
    from tokenizers import Tokenizer

    library = test_ids_and_texts_are_those_of_the_library.__dict__.setdefault("library", Tokenizer.from_file(PATH))
    own = bpe.encoder(PATH)
    raw = own.encode([text])[0]
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(raw) == want
    assert own.decode([raw])[0] == library.decode(want, skip_special_tokens=False)


def test_runs_special_tokens_and_long_words(library):
    texts = ["aaaaaaa", "<|endoftext|><|endoftext|>x", "ab" * 3000, " " * 999, "x\x1c\x85y", None, ""]
    for text, raw in zip(texts, bpe.encoder(PATH).encode(texts), strict=True):
        assert ids(raw) == library.encode(text or "", add_special_tokens=False).ids
    assert len(ids(bpe.encoder(PATH).encode(["<|endoftext|>"], specials=False)[0])) > 1


def test_broken_utf8_becomes_replacement_characters(library):
    first = library.encode("é", add_special_tokens=False).ids
    broken = np.array([bpe.encoder(PATH).byte_ids[0xC3]], "<u4").tobytes()
    assert bpe.encoder(PATH).decode([broken, None]) == ["�", ""] and first


def test_forgetting_changes_nothing():
    small, texts = bpe.PairIndexEncoder(PATH, remember=3), ["one two three four", "five six", "one six"]
    assert [small.encode([t])[0] for t in texts * 2] == bpe.encoder(PATH).encode(texts * 2)


def test_columns(odd):
    made = bpe.encode_and_decode(odd, PATH)
    rows = made.collect()
    assert set(made.columns) == set(odd.columns) and all(r.decoded == (r.text or "") for r in rows)
    assert bpe.decode(bpe.encode(odd, PATH), PATH).count() == 8
    assert bpe.encode(odd.limit(0), PATH).count() == 0


@pytest.mark.parametrize("block", [2, 6, 1 << 20])
def test_lengths_of_written_documents(spark, odd, tmp_path, block):
    folder = f"file://{tmp_path}/tokens"
    written = write_token_files(odd, folder, PATH, 50256)
    got = written.join(document_lengths(spark, folder, 50256, block_bytes=max(block, 2000) if block > 6 else block * 5000), ["file", "ordinal"]).collect()
    want = {r.doc_id: len(r.ids) // 4 for r in bpe.encode(odd.where("doc_id < 6 or doc_id is null"), PATH).collect()}
    assert len(got) == 8 and {r.doc_id: r.n_tokens for r in got if r.doc_id != 6} == want


@pytest.mark.parametrize("block", [2, 4, 6, 1000])
def test_boundaries_of_flat_files(spark, tmp_path, block):
    r = np.random.default_rng(1)
    for name, end in (("a.bin", True), ("b.bin", False), ("c.bin", True)):
        tokens = r.integers(0, 4, 57).astype("<u2")  # 0 separates
        if end:
            tokens[-1] = 0
        tokens.tofile(tmp_path / name)
    (tmp_path / "empty.bin").touch()
    want = set()
    for name in ("a.bin", "b.bin", "c.bin"):
        parts = "".join(map(str, np.fromfile(tmp_path / name, "<u2"))).split("0")
        want |= {(name, i, len(p)) for i, p in enumerate(parts) if i < len(parts) - 1 or p}
    got = document_lengths(spark, f"file://{tmp_path}", 0, block_bytes=block).collect()
    assert {(x.file, x.ordinal, x.n_tokens) for x in got} == want and len(got) == len(want)


def test_no_documents(spark, odd, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert write_token_files(odd.limit(0), folder, PATH, 50256).count() == 0
    assert document_lengths(spark, folder, 50256).count() == 0


def test_ids_that_a_type_cannot_hold(spark, docs, tmp_path):
    with pytest.raises(ValueError, match="hold"):
        write_token_files(docs(["x"]), f"file://{tmp_path}/t", PATH, 70_000, "<u2")
    with pytest.raises(ValueError, match="hold"):
        document_lengths(spark, f"file://{tmp_path}", 70_000)
    tokens = np.array([70_000, 65_536, 5, 70_000, 0, 70_000], "<u4")
    tokens.tofile(tmp_path / "wide.bin")
    assert sorted((r.ordinal, r.n_tokens) for r in document_lengths(spark, f"file://{tmp_path}/wide.bin", 70_000, "<u4", 8).collect()) == [(0, 0), (1, 2), (2, 1)]


def test_files_of_failed_attempts_go(spark, docs, tmp_path):
    from terrafold.llm.token_counts import forget_others

    folder = f"file://{tmp_path}/files"
    written = write_token_files(docs(["one two", "three"]), folder, PATH, 50256)
    (tmp_path / "files" / "000000-lost.bin").write_bytes(b"\0\0")
    assert forget_others(spark, folder, written) == 1
    assert document_lengths(spark, folder, 50256).count() == 2


@pytest.mark.parametrize("group", [1, 2, 5])
def test_groups_of_ranges(spark, tmp_path, monkeypatch, group):
    from terrafold.llm import token_counts

    monkeypatch.setattr(token_counts, "GROUP_RANGES", group)
    r = np.random.default_rng(group)
    tokens = np.where(r.random(300) < 0.03, 0, 9).astype("<u2")
    tokens.tofile(tmp_path / "one.bin")
    parts = "".join(map(str, tokens)).split("0")
    want = {(i, len(p)) for i, p in enumerate(parts) if i < len(parts) - 1 or p}
    assert {(x.ordinal, x.n_tokens) for x in document_lengths(spark, f"file://{tmp_path}", 0, block_bytes=14).collect()} == want
