"""Quality classifier: a generalised additive model with pairwise interactions (operator 9).

Features of a text are cut into bins.  Cyclic boosting visits one feature after the other and adds a small step of a
shallow tree to that feature's table of bin values; then pairs of features with the largest gain get tables of
their own in the same way.  A score is a sum of table values, looked up for all texts of a batch at once.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import map_rows, table

#: Parameters: labelled rows at most, bins of a feature and of a side of a pair, pairs, rounds, step and smoothing.
LABELLED, BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, SMOOTH = 20_000, 32, 8, 6, 60, 0.15, 2.0
#: Fixed value: documents with a lower score are predicted to be bad.
THRESHOLD = 0.3

FEATURES = (
    "words", "chars_a_word", "longest_word", "distinct_words", "commonest_word", "symbols", "upper", "shouts", "bars", "digits",
    "points", "commas", "not_ascii", "lines", "dup_lines", "words_a_line", "odd_ends", "capital_words", "distinct_pairs", "spaces",
)
_ODD_END = re.compile(r"[^\w\s.,;:!?\"')]\s|[!?]{2,}")


def features(text: str | None) -> list[float]:
    """Numbers for the whole text; an empty one gives zeros."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars, counts = len(words), len(text), Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    solid = sum(map(len, words))
    ascii_only = text.isascii()
    plain = text if ascii_only else text.encode("ascii", "ignore").decode()
    raw = plain.encode()
    return [
        float(np.log1p(n)),
        solid / n,
        float(np.log1p(max(map(len, counts)))),
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        1 - len(raw.translate(None, b"#*$%&<>=~^_{}[]\\/@+")) / max(1, len(raw)),
        1 - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / max(1, len(raw)),
        text.count("!") / n,
        text.count("|") / n,
        1 - len(raw.translate(None, b"0123456789")) / max(1, len(raw)),
        text.count(".") / n,
        text.count(",") / n,
        1 - len(plain) / chars,
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        len(_ODD_END.findall(text)) / n,
        sum(map(str.istitle, words)) / n,
        len(set(zip(words, words[1:]))) / n,
        (chars - solid) / n,
    ]


@dataclass
class AdditiveModel:
    """Tables of bin values: one for each feature and for each chosen pair."""

    start: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def binned(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for table, bins in zip(self.tables, self.binned(x, self.cuts), strict=True):
            out += table[bins]
        wide = self.binned(x, self.pair_cuts)
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[wide[i], wide[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _quantiles(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]


def _step(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values of a tree with few leaves over the ordered bins, from sums of gradients and curvatures for each bin."""
    parts, gain = [(0, len(g))], lambda a, b: a * a / (b + SMOOTH)
    while len(parts) < leaves:
        best = (1e-9, 0, 0)
        for k, (low, high) in enumerate(parts):
            if high - low > 1:
                sg, sh = g[low:high].cumsum(), h[low:high].cumsum()
                more = gain(sg[:-1], sh[:-1]) + gain(sg[-1] - sg[:-1], sh[-1] - sh[:-1]) - gain(sg[-1], sh[-1])
                if more.max() > best[0]:
                    best = (float(more.max()), k, low + 1 + int(more.argmax()))
        if not best[2]:
            break
        low, high = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(low, best[2]), (best[2], high)]
    out = np.zeros(len(g))
    for low, high in parts:
        out[low:high] = RATE * g[low:high].sum() / (h[low:high].sum() + SMOOTH)
    return out


def _pair_step(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a table into four quarters: its gain, and its values."""
    def summed(a: np.ndarray) -> list[np.ndarray]:
        c = np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        low = c[1:-1, 1:-1]
        top, left, all_ = c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return [low, top - low, left - low, all_ - top - left + low]

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    sg, sh = summed(g), summed(h)
    gain = sum(a * a / (b + SMOOTH) for a, b in zip(sg, sh, strict=True)) - g.sum() ** 2 / (h.sum() + SMOOTH)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out, v = np.zeros_like(g), [RATE * a[i, j] / (b[i, j] + SMOOTH) for a, b in zip(sg, sh, strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boosted on features ``x`` and labels ``y`` (1: good).  Labels of one class, or none, give their own share as every score."""
    model = AdditiveModel()
    if not len(y):
        x = np.zeros((1, len(FEATURES)))
        model.cuts = model.pair_cuts = [np.empty(0)] * len(FEATURES)
        model.tables = [np.zeros(1) for _ in FEATURES]
        return model
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.start = float(np.log(share / (1 - share)))
    model.cuts, model.pair_cuts = _quantiles(x, BINS), _quantiles(x, PAIR_BINS)
    bins, wide = model.binned(x, model.cuts), model.binned(x, model.pair_cuts)
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if y.min() == y.max():
        return model
    margin = np.full(len(y), model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for own, table in zip(bins, model.tables, strict=True):
            g, h = slopes()
            table += (add := _step(np.bincount(own, g, len(table)), np.bincount(own, h, len(table))))
            margin += add[own]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1)
        at, (g, h) = wide[i] * shape[1] + wide[j], slopes()
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    gains = {(i, j): _pair_step(*sums(i, j))[0] for i in range(x.shape[1]) for j in range(i)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pair_tables = [np.zeros((len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1)) for i, j in model.pairs]
    for _ in range(ROUNDS // 2):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            table += (add := _pair_step(*sums(i, j))[1])
            margin += add[wide[i], wide[j]]
    return model


def held_out() -> Column:
    """Whether labels of a document may not be learned from; a document without id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> AdditiveModel:
    """A model from at most ``limit`` labelled documents that are not held out, the same ones each time.

    Of rows that repeat a doc_id the one with the least features counts, so at most ``limit`` rows come to the driver, however often rows
    repeat.  A document with several labels has the largest.  Null labels and ids are left out; no labels give a model of even scores.
    """
    chosen = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select(F.col("doc_id").alias("__id"), "quality")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))  # ``limit`` rows at most
    made = map_rows(texts, lambda own: [[features(t) for t in own]], ["text"], [("x", pa.list_(pa.float64()), "array<double>")], ["doc_id", "quality"])
    rows = made.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, (rows["quality"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: AdditiveModel, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` (default: all columns but ``name``), then the score of the whole text, however long, as column ``name``.

    Null is an empty text, which has a score as well.  Rows that repeat, and texts of equal features, have equal scores; an empty
    table gives no rows.  A column ``name`` of ``docs`` is replaced.
    """
    keep = [c for c in docs.columns if c != name] if keep is None else keep
    return map_rows(docs, lambda texts: [model.score(np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))).tolist()], ["text"], [(name, pa.float64(), "double")], keep)


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
