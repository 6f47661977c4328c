"""Personal data by candidate gradient boosting (operator 5).

Generators with high recall propose overlapping spans: many written forms of addresses and numbers, also ones that are no
personal data.  Boosted trees score each candidate from its format and from the words around it; a threshold for each
kind, calibrated on examples that the trees did not see, selects spans.  Matches of the four base patterns always stay.
The trees learn from examples that this module writes itself, so training needs no table and no hidden state.
"""

from __future__ import annotations

import bisect
import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import map_rows, table
from terrafold.llm.secret_scan import SPAN, SPAN_SQL, apart, spelled

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

#: The base patterns.  Possessive runs and the looks behind keep long runs linear and change no match.
_AT = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
CARD_DIGITS, PHONE_DIGITS = (12, 19), (9, 15)

#: Generators of further candidates, by kind.
_MORE = {
    "email": re.compile(r"[\w.%+-]{1,64}\s?(?:@|\(at\)|\[at\]|\{at\}|\s(?:at|AT)\s)\s?[\w-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\s(?:dot|DOT)\s)\s?[\w-]{1,63}){1,4}"),
    "ip": re.compile(r"(?<![\w:.])(?:[0-9a-fA-F]{1,4}:){2,7}(?::?[0-9a-fA-F]{1,4}){1,6}(?![\w:])|(?<![\w:.])[0-9a-fA-F]{1,4}::[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5}(?![\w:])|(?<![\w.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\))\s?[0-9]{1,3}){3}(?![\w.])"),
    "card": re.compile(r"(?<![\w.+-])[0-9]{4}(?:[ ./_–-]{0,2}[0-9]{3,6}){2,4}(?![\w-])"),
    "phone": re.compile(r"(?<![\w.+-])(?:00|\+|\()?[0-9](?:[ ()./–-]{0,2}[0-9]){6,16}(?![\w-])"),
}
#: What a text must have for a generator to run.
_NEEDS = {"email": re.compile(r"@|\Wat\W|\sAT\s"), "ip": re.compile(r"[0-9a-fA-F]:[0-9a-fA-F:]|\[\.\]|\(\.\)"), "card": _DIGIT, "phone": _DIGIT}

_CONTEXT = (
    re.compile(r"e-?mail|mail|contact|write|reach|send|courriel|correo|kontakt|@", re.I),
    re.compile(r"\bip\b|host|address|server|login|client|from|peer|gateway", re.I),
    re.compile(r"card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta|cvv", re.I),
    re.compile(r"phone|tel|call|mobile|cell|fax|dial|whatsapp|sms|telefon|tél|número", re.I),
    re.compile(r"version|release|order|invoice|isbn|issn|id\b|ref|part|serial|total|price|date|year|page|section|model|sku|no\.|#", re.I),
)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each base pattern; one that fails its check is dropped without another try."""
    found: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _AT.match(text, at) if start < at else None
        if m:
            end = m.end()
            found.append((start, end, "email"))
        at = text.find("@", max(at + 1, end if m else 0))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if CARD_DIGITS[0] <= len(d) <= CARD_DIGITS[1] and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if PHONE_DIGITS[0] <= len(_digits(m[0])) <= PHONE_DIGITS[1]]
    return found


def candidates(text: str) -> list[Span]:
    """All spans that the generators propose; they may overlap."""
    out = [(m.start(), m.end(), kind) for kind, p in _MORE.items() if _NEEDS[kind].search(text) for m in p.finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    start, end, kind = span
    own, left, right = text[start:end], text[max(0, start - 32) : start], text[end : end + 16]
    digits = _digits(own)
    groups = re.findall(r"[0-9]+", own)
    near = left[-32:] + " " + right
    tail = re.split(r"[^A-Za-z]+", own.rstrip())[-1]
    return [
        float(KINDS.index(kind)),
        float(len(own)),
        float(len(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(bool(digits) and luhn(digits)),
        float(own.count(" ")),
        float(sum(own.count(c) for c in "-–")),
        float(own.count(".")),
        float(sum(own.count(c) for c in "()[]{}")),
        float("@" in own or "(at)" in own or "[at]" in own or "{at}" in own),
        float(bool(re.search(r"\s(?:at|AT)\s", own))),
        float(bool(re.search(r"\W(?:dot|DOT)\W", own))),
        float(tail.lower() in ("com", "org", "net", "edu", "de", "fr", "es", "io", "gov", "uk", "info")),
        float(own[:1] in "+(" or own.startswith("00")),
        float(own.count(":")),
        float(max((int(g) for g in groups if len(g) < 4), default=999) <= 255),
        float(len(set(digits))),
        *[float(bool(c.search(near))) for c in _CONTEXT],
        float(left[-1:] not in ("", " ", "\n", "\t", ":", "(", '"')),
    ]


class BoostedTrees:
    """Logistic boosting of shallow trees over a few bins of each feature."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, leaf: float = 1.0):
        self.rounds, self.depth, self.rate, self.leaf = rounds, depth, rate, leaf
        self.trees: list[list] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(len(y), self.start)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.03, 0.97, 24))) for j in range(x.shape[1])]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), cuts, self.depth)
            self.trees.append(tree)
            score += self._apply(tree, x)
        return self

    def _grow(self, x, g, h, rows, cuts, depth) -> list:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = self.rate * total_g / (total_h + self.leaf)
        if not depth or len(rows) < 8:
            return [value]
        best, base = (1e-6, -1, 0.0), total_g**2 / (total_h + self.leaf)
        for j, own in enumerate(cuts):
            bins = np.searchsorted(own, x[rows, j], "right")
            sum_g, sum_h = np.bincount(bins, g[rows], len(own) + 1).cumsum()[:-1], np.bincount(bins, h[rows], len(own) + 1).cumsum()[:-1]
            gain = sum_g**2 / (sum_h + self.leaf) + (total_g - sum_g) ** 2 / (total_h - sum_h + self.leaf) - base
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), j, float(own[int(gain.argmax())]))
        if best[1] < 0:
            return [value]
        left = x[rows, best[1]] < best[2]
        return [best[1], best[2], self._grow(x, g, h, rows[left], cuts, depth - 1), self._grow(x, g, h, rows[~left], cuts, depth - 1)]

    def _apply(self, tree: list, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        return np.where(x[:, tree[0]] < tree[1], self._apply(tree[2], x), self._apply(tree[3], x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + sum(self._apply(t, x) for t in self.trees))))


def examples(seed: int, n: int) -> list[tuple[str, list[Span]]]:
    """Sentences with personal data in many forms, and with what only looks like it; the true spans of each."""
    r = random.Random(seed)
    words = ["the", "of", "report", "river", "on", "was", "then", "with", "house", "la", "und", "les", "casa", "time", "it", "market", "is", "for", "stone"]
    some = lambda a, b: " ".join(r.choice(words) for _ in range(r.randint(a, b)))
    name = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(valid: bool) -> str:
        while True:
            d = r.choice("3456") + num(15)
            if luhn(d) == valid:
                sep = r.choice([".", "/", "_", " ", "-", ""])
                return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    phone = lambda: r.choice(["({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "{a} {b} {c}", "00{d} {a} {b}{c}", "0{a}/{b}{c}"]).format(a=num(3), b=num(3), c=num(4), d=num(2))
    host = lambda: f"{name()}{r.choice(['', '-' + name()])}"
    mail = lambda: r.choice(["{u} [at] {h} [dot] {t}", "{u}(at){h}.{t}", "{u} at {h} dot {t}", "{u} @ {h}.{t}", "{u}@{h}(dot){t}", "{u} AT {h} DOT {t}"]).format(u=name() + r.choice(["", "." + name(), num(2)]), h=host(), t=r.choice(["com", "org", "net", "de", "fr", "io"]))
    groups = lambda n: ":".join(f"{r.randint(1, 65535):x}" for _ in range(n))
    ip = lambda: r.choice([lambda: r.choice(["[.]", "(.)"]).join(str(r.randint(1, 254)) for _ in range(4)), lambda: groups(8), lambda: f"{groups(r.randint(1, 4))}::{groups(r.randint(1, 3))}"])()
    kinds = {
        "email": (mail, ["mail me:", "contact", "write to", "e-mail", "reach us"]),
        "ip": (ip, ["host", "server", "from", "client ip", "address"]),
        "card": (lambda: card(True), ["card", "visa", "paid by credit card", "card no", "debit card"]),
        "phone": (phone, ["call", "phone", "tel.", "mobile:", "fax"]),
    }
    decoys = [
        lambda: f"version {r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1950, 2030)}", lambda: f"{r.randint(1950, 2030)}-{num(2)}-{num(2)} {num(2)}:{num(2)}:{num(2)}",
        lambda: f"order {num(r.randint(7, 14))}", lambda: num(16), lambda: num(r.randint(7, 12)), lambda: card(False), lambda: f"ISBN 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: f"total {num(3)} {num(3)} {num(3)}", lambda: f"{num(2)}:{num(2)}:{num(2)}",
        lambda: f"{some(1, 2)} at {some(1, 1)}. {some(1, 1)}", lambda: f"{r.choice(words)} at {r.choice(words)}.", lambda: f"id {num(4)}-{num(4)}-{num(4)}", lambda: f"invoice {num(3)}/{num(4)}/{num(4)}", lambda: f"pages {num(3)}-{num(3)}, {num(4)}", lambda: "-".join([num(4), num(4)]), lambda: f"{r.choice(words)} at {r.choice(words)} . {r.choice(words)}",
        lambda: f"{name()} at {name()}. {name()} {name()}",
    ]
    out = []
    for _ in range(n):
        text, spans = some(1, 8) + " ", []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.4:
                kind = r.choice(KINDS)
                make, before = kinds[kind]
                text += (r.choice(before) + " ") if r.random() < 0.85 else ""
                own = make()
                spans.append((len(text), len(text) + len(own), kind))
                text += own
            else:
                text += r.choice(decoys)()
            text += r.choice([" ", ", ", ". ", "\n"]) + some(1, 6) + " "
        out.append((text, spans))
    return out


@functools.lru_cache(maxsize=1)
def model(seed: int = 7, learn: int = 3000, hold: int = 3000, precision: float = 0.995) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees, and for each kind the least threshold at which held-out examples reach ``precision`` (2: none does)."""

    def rows(data: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        found = [(t, c, float(c in truth)) for t, truth in data for c in candidates(t)]
        return np.array([features(t, c) for t, c, _ in found]), np.array([y for *_, y in found]), [c[2] for _, c, _ in found]

    x, y, _ = rows(examples(seed, learn))
    trees = BoostedTrees().fit(x, y)
    x, y, kinds = rows(examples(seed + 1, hold))
    score, cut = trees.predict(x), {}
    for kind in KINDS:
        own = np.array([k == kind for k in kinds])
        order = np.argsort(-score[own], kind="stable")
        s, right = score[own][order], y[own][order].cumsum()
        good = np.flatnonzero((right / np.arange(1, len(s) + 1) >= precision) & (np.append(s[1:], -1) < s))
        cut[kind] = max(0.5, float(s[good[-1]])) if len(good) else 2.0
    return trees, cut


def best_apart(scored: list[tuple[float, Span]]) -> list[Span]:
    """Spans that overlap none that scores higher; of equal scores the first, then the longer one counts."""
    chosen: list[Span] = []
    for _, span in sorted(scored, key=lambda x: (-x[0], x[1][0], -x[1][1])):
        i = bisect.bisect_left(chosen, (span[0], span[1], ""))
        if (i == 0 or chosen[i - 1][1] <= span[0]) and (i == len(chosen) or span[1] <= chosen[i][0]):
            chosen.insert(i, span)
    return chosen


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each sorted.  A span of the trees joins where it overlaps no span that scores higher."""
    return scan_all([text])[0]


def scan_all(texts: list[str | None], trained: tuple[BoostedTrees, dict[str, float]] | None = None) -> list[tuple[list[Span], list[Span]]]:
    """``scan`` of each text; ``trained``: see ``model``."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = [sorted(base_spans(t), key=order) if t else [] for t in texts]
    asked = [(i, c) for i, t in enumerate(texts) if t for c in apart(candidates(t), base[i])]
    more: dict[int, list[tuple[float, Span]]] = {}
    if asked:
        trees, cut = trained or model()
        for (i, c), s in zip(asked, trees.predict(np.array([features(texts[i], c) for i, c in asked])).tolist(), strict=True):
            if s >= cut[c[2]]:
                more.setdefault(i, []).append((s, c))
    return [(own, sorted(own + best_apart(more.get(i, [])), key=order)) for i, own in enumerate(base)]


def find_personal_data(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns but the new ones), then base_spans and spans: arrays of start, end, kind.

    Offsets are in code points, end exclusive.  Null and empty texts have no spans; very long ones are scanned whole.  Ties: see
    ``best_apart``.  Rows that repeat are scanned each for itself; an empty table gives no rows.  Columns of ``df`` with the names of
    the new ones are replaced.  The trees are fitted once, on the driver.
    """
    keep, trained = [c for c in df.columns if c not in ("base_spans", "spans")] if keep is None else keep, model()

    def run(texts: list[str | None]) -> list[list]:
        found = scan_all(texts, trained)
        return [[[dict(zip(("start", "end", "kind"), s, strict=True)) for s in f[i]] for f in found] for i in (0, 1)]

    return map_rows(df, run, [text], [("base_spans", SPAN, SPAN_SQL), ("spans", SPAN, SPAN_SQL)], keep)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts of the base kinds, digest of the base spans, all spans."""
    found = find_personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(spelled("base_spans").cast("binary"), 256).alias("base_sha256"), spelled("spans").alias("spans"))
