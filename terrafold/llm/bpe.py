"""Byte-level BPE encoding and decoding by a pair occurrence index (operator 2).

Words that a piece of texts brings for the first time are encoded together.  Their bytes form one array of symbols,
linked to their neighbours.  The index holds, for each pair that has a rank, all places where it occurs.  Active ranks
are taken in ascending order from a heap; all places of a pair merge at once, and the lists of the pairs that the merge
makes are updated.  Words are independent of each other and the smallest rank of all is the smallest of each word that
has it, so this gives what merging word by word gives.

Each worker keeps the ids of words it has seen in a table of bounded size, so most words of a corpus are looked up there and the
index works on the new ones; the table changes speed only.  Memory is bounded by the bytes of a piece of texts
(``common.PIECE_BYTES``), of the words that are encoded together, and of the table, which is emptied between pieces.
"""

from __future__ import annotations

import functools
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import CACHES, map_rows, table

#: Fixed value: how the byte-level vocabulary splits text into words before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Parameters: new words, and bytes of them, that are encoded together at most, and words that a worker remembers.
TOGETHER, TOGETHER_BYTES, REMEMBER = 49_152, 4 << 20, 100_000

_DEAD, _SHIFT, _NO_RANK = -2, 20, 1 << 40


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(moved)) for b in range(256)]


class _Numbered(dict):
    """Numbers words as they come, so that a text is held as four bytes a word; ``fresh`` has those not encoded yet."""

    def __init__(self) -> None:
        self.fresh: list[str | int] = []

    def __missing__(self, word: str | int) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class PairIndexEncoder:
    """Encoder and decoder for one vocabulary file of the byte-level BPE kind."""

    def __init__(self, path: str, remember: int = REMEMBER):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.pieces = [b""] * (1 + max([*vocabulary.values(), *[t["id"] for t in spec["added_tokens"]]]))
        for token, i in vocabulary.items():
            self.pieces[i] = bytes(byte_of[c] for c in token)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.specials.items():
            self.pieces[i] = token.encode()
        self.byte_ids = np.array([vocabulary[c] for c in byte_characters()], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        keys = np.array([(a << _SHIFT) | b for a, b, _ in self.merges], np.int64)
        first = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[first], first.astype(np.int64)
        self.split = regex.compile(SPLIT)
        # longest first, as a shorter special token may begin a longer one
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.remember = remember
        self.seen, self.ids = _Numbered(), []

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NO_RANK)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (not empty) as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        starts, n = ends - lengths, int(ends[-1])
        symbols = np.append(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)], np.int32(-1))  # one more place: outside
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1], before[starts] = n, n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(places: np.ndarray) -> None:
            rank = self._rank(symbols[places], symbols[after[places]])
            places = places[(found := rank < _NO_RANK)]
            if not len(places):
                return
            rank = rank[found]
            order = np.argsort(rank, kind="stable")
            rank, places = rank[order], places[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, own in zip(rank[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(own)

        add(np.flatnonzero(after[:n] != n))
        while active:
            rank = heapq.heappop(active)
            left, right, merged = self.merges[rank]
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = np.unique(at)
            then = after[at]
            live = (symbols[at] == left) & (symbols[then] == right)
            at, then = at[live], then[live]
            if left == right and len(at) > 1 and (touch := then[:-1] == at[1:]).any():
                place = np.arange(len(at))
                run = np.maximum.accumulate(np.where(np.append(True, ~touch), place, 0))
                odd = (place - run) % 2 == 0  # in a run of one symbol pairs are taken from the left, without overlap
                at, then = at[odd], then[odd]
            if not len(at):
                continue
            symbols[at], symbols[then] = merged, _DEAD
            following = after[then]
            after[at] = following
            before[following] = at
            preceding = before[at]
            add(np.concatenate((preceding[preceding != n], at[following != n])))
        live = symbols[:n] >= 0
        counts = np.add.reduceat(live, starts, dtype=np.int64)
        ids = symbols[:n][live].astype("<u4").tobytes()
        cut = np.append(0, np.cumsum(counts) * 4).tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def encode(self, texts: Iterable[str | None], specials: bool = True) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; None is an empty text.

        specials: whether the strings of special tokens get their ids, or are ordinary text.
        """
        split, rows = self.split.findall, []
        if len(self.seen) > self.remember:
            self.seen, self.ids = _Numbered(), []
        number = self.seen.__getitem__
        for text in texts:
            if not text:
                rows.append(())
            elif specials and self.special_split is not None and any(s in text for s in self.specials):
                parts = enumerate(self.special_split.split(text))
                rows.append(array("I", map(number, chain.from_iterable([self.specials[p]] if i % 2 else split(p) for i, p in parts))))
            else:
                rows.append(array("I", map(number, split(text))))
        fresh, self.seen.fresh = self.seen.fresh, []
        made = chain.from_iterable(map(self.encode_words, together(w.encode() for w in fresh if isinstance(w, str))))
        self.ids += [next(made) if isinstance(w, str) else w.to_bytes(4, "little") for w in fresh]
        ids = self.ids.__getitem__
        return [b"".join(map(ids, row)) for row in rows]

    def decode(self, rows: Iterable[bytes | None]) -> list[str]:
        """Texts of ids; bytes that are no UTF-8 become the replacement character."""
        piece = self.pieces.__getitem__
        return [b"".join(map(piece, np.frombuffer(row or b"", "<u4").tolist())).decode("utf-8", "replace") for row in rows]


def together(words: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Runs of words that are bounded in number and, unless one word alone is longer, in bytes."""
    run: list[bytes] = []
    size = 0
    for w in words:
        if run and (len(run) >= TOGETHER or size + len(w) > TOGETHER_BYTES):
            yield run
            run, size = [], 0
        run.append(w)
        size += len(w)
    if run:
        yield run


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexEncoder:
    """One encoder for each vocabulary and worker process."""
    return PairIndexEncoder(path)


CACHES[__name__] = encoder.cache_clear


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, specials: bool = True) -> DataFrame:
    """``keep`` (default: all columns but ``ids``), then ``ids`` (binary, little-endian unsigned 32-bit integers).

    specials: whether the strings of special tokens get their ids, or are ordinary text.  Null and empty texts give no ids; very
    long texts are encoded whole; an empty table gives no rows.  A column named ``ids`` in ``df`` is replaced.
    """
    keep = [c for c in df.columns if c != "ids"] if keep is None else keep
    return map_rows(df, lambda texts: [encoder(path).encode(texts, specials)], [text], [("ids", pa.binary(), "binary")], keep)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns but ``decoded``), then ``decoded`` (string).  Null ids give an empty text."""
    keep = [c for c in df.columns if c != "decoded"] if keep is None else keep
    return map_rows(df, lambda rows: [encoder(path).decode(rows)], [ids], [("decoded", pa.string(), "string")], keep)


def encode_and_decode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, specials: bool = True) -> DataFrame:
    """``encode`` and ``decode`` in one pass over the texts: ``keep``, ``ids``, ``decoded``.

    Null and empty texts give no ids and an empty text; very long texts are encoded whole; rows that repeat are encoded each for
    itself; an empty table gives no rows.  Columns of ``df`` named ``ids`` or ``decoded`` are replaced.  Pairs of equal rank merge from the left.
    """
    keep = [c for c in df.columns if c not in ("ids", "decoded")] if keep is None else keep

    def both(texts: list[str | None]) -> list[list]:
        ids = encoder(path).encode(texts, specials)
        return [ids, encoder(path).decode(ids)]

    return map_rows(df, both, [text], [("ids", pa.binary(), "binary"), ("decoded", pa.string(), "string")], keep)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    made = encode_and_decode(table(spark, sf_dir, "documents"), vocabulary_path(), keep=["doc_id"])
    return made.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
