from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that the operators use for columns of their own.
CLASHES = ("ids", "spans", "base_spans", "score", "key", "text_crc32", "shard", "kept", "component_id", "size", "decoded", "n_words", "items", "stratum", "quality", "node", "bands")


def documents(spark, texts, first=1):
    return spark.createDataFrame([(i + first, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda texts, first=1: documents(spark, texts, first)


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash."""
    long = "word and more " * 20_000
    rows = [(1, "a b c d e f g h i j k l", "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "de"), (5, long, "en"), (5, long, "en"), (None, "x y z", "en"), (6, "日本 é 😀 <|endoftext|> token = \"abcdef123\"", None)]
    df = spark.createDataFrame([(d, t, lang, "s", 0, *["clash"] * len(CLASHES)) for d, t, lang in rows], SCHEMA + "".join(f", {c} string" for c in CLASHES))
    return df
