"""Secret scans by assignment-aware lexing (operator 6).

Source and configuration syntax is lexed into names, literals and operators.  An operator that binds (``=``, ``:=``,
``:``, ``=>``) after a name pairs that name with the literals that follow, joined by ``+`` or ``.`` or standing side by
side; names on the right stand for what an earlier pair gave them, so constants propagate.  In lines that begin with
NAME = or NAME: a bare word is a literal too, up to white space, comma or line end, unless it is a name or an expression.
A string in triple quotes is a literal of any number of lines; the lines inside are lexed as well.
A literal scores by how sensitive its target names are and by its own form.  Patterns with a fixed form (assign, access, hex) are always kept.
Texts are lexed whole, in time about linear in their length; what a name stands for is shared and not copied, however many parts it has.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import map_rows, table

#: The three base patterns, with the least lengths of what they find.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex")

#: Weights of name parts, and literals that stand for a secret without being one.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.5, "access": 0.4, "key": 0.5, "api": 0.5, "signing": 0.4, "client": 0.1}
PLACEHOLDER = re.compile(r"change_?me|your|example|placeholder|dummy|redacted|xxx|\*\*\*|\$\{|\{\{", re.I)
#: Parameter: longer literals hold such a word by chance.
PLACEHOLDER_CHARS = 64
EMPTY_VALUE = re.compile(r"<.*>|none|null|true|false|undefined|todo|test", re.I)

_MAYBE = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
#: A run of at least 24: ends are looked for at every 24th place first, so text without one costs little.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
#: An apostrophe after a letter, as in don't, opens no string, but one after a prefix does: b'', or = N''.
_APOSTROPHE = r"(?:(?<!\w)|(?<=\b[bfruBFRU])|(?<=\b[bfrBFR][bfrBFR])|(?<=[=:(,+][A-Za-z])|(?<=[=:(,+]\x20[A-Za-z]))'"
_STRINGS = {'"': r'"(?:[^"\\\n]|\\.)*+"', "'": _APOSTROPHE + r"(?:[^'\\\n]|\\.)*+'", "`": r"`[^`\n]*+`"}
_OPENS = {'"': '"', "'": _APOSTROPHE, "`": "`"}
#: What follows a string; anything else right after a closing quote tells that this quote opens one.
_AFTER_STRING = frozenset(" \t\r+,;:.)]}<>=%&|?*-\"'`")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_BIND = re.compile(r"[=:]")
#: A line NAME = value or NAME: value, also as an item of a list or after a keyword that declares it; the value has no quotes and no call.
_BARE = re.compile(r"""[^\S\n]*+(?:-[^\S\n]++)?(?:(?:export|set|env|let|const|var)[^\S\n]++)?["']?[A-Za-z_][\w.-]*+["']?[^\S\n]*+(?P<bind>:=|=>|[=:](?![=:/>]))[^\S\n]*+(?P<value>[^\s,"'`(\[{][^\s,"'`]*+)(?!["'`])""", re.I | re.A)
_CALL, _PATH, _WORD = re.compile(r"[A-Za-z_][\w.]*[(\[]"), re.compile(r"[A-Za-z_]\w*(?:(?:\.|->|::)[A-Za-z_]\w*)+"), re.compile(r"[A-Za-z_]\w*")
_TRIPLE, _PREFIX, _DASHED = re.compile(r'"""|\'\'\''), re.compile(r"(?<!\w)[A-Za-z]{0,2}\Z"), re.compile(r"-----[A-Z0-9 ]+-----")
_REFERENCE, _EXPRESSION = re.compile(r"\$[\w({]"), re.compile(r"[^\S\n]*+[+.(\[?]")
#: What each sensitive name contains: a text without any of these has no pair that counts.
_HINTS = tuple(p for p in SENSITIVE if not any(q != p and q in p for q in SENSITIVE))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost matches of each kind that do not overlap; a match that is too short is dropped without another try."""
    found = []
    if _MAYBE.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return found


def sensitivity(name: str) -> float:
    """Of a target name, from its parts in camel, snake, kebab or dotted case: 0 to 1."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return min(1.0, sum(SENSITIVE.get(p, 0.0) for p in dict.fromkeys(parts)))


class Value:
    """What a name was given: literals (text, start, end) and values of other names, which are shared.

    ``measure`` sums up its characters, from sums of its parts that are kept; counts are scaled down before they become too large.
    """

    __slots__ = ("parts", "sums", "marked")

    def __init__(self, *parts: tuple[str, int, int] | Value):
        self.parts, self.sums, self.marked = list(parts), None, False

    def measure(self) -> tuple[float, Counter, bool, bool]:
        """Length, counts of characters, whether any literal has white space or is a placeholder."""
        todo = [self]
        while todo:
            own = todo[-1]
            if own.sums is None and (missing := [p for p in own.parts if isinstance(p, Value) and p.sums is None]):
                todo += missing
                continue
            todo.pop()
            if own.sums is None:
                length, counts, spaced, empty = 0.0, Counter(), False, False
                for p in own.parts:
                    if isinstance(p, Value):
                        more, other, gaps, holds = p.sums
                    else:
                        more, other, gaps, holds = len(p[0]), Counter(p[0]), any(c.isspace() for c in p[0]), len(p[0]) <= PLACEHOLDER_CHARS and bool(PLACEHOLDER.search(p[0]))
                    length, spaced, empty = length + more, spaced or gaps, empty or holds
                    counts.update(other)
                if length > 1e12:
                    length, counts = length * 1e-9, Counter({c: n * 1e-9 for c, n in counts.items()})
                own.sums = (length, counts, spaced, empty)
        return self.sums

    def score(self) -> float:
        """How much the whole looks like a secret by length, variety and kinds of characters: 0 to 1."""
        length, counts, spaced, empty = self.measure()
        if length < 6 or spaced or empty or (len(self.parts) == 1 and not isinstance(self.parts[0], Value) and EMPTY_VALUE.fullmatch(self.parts[0][0])):
            return 0.0
        entropy = -sum(c / length * math.log2(c / length) for c in counts.values() if c)
        kinds = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
        return min(1.0, entropy / 4 * 0.6 + (kinds - 1) * 0.25)

    def spans(self, again: bool = True) -> Iterator[tuple[str, int, int]]:
        """Its literals, each once; with ``again`` false those that an earlier call gave are left out."""
        todo, seen = [self], set()
        while todo:
            own = todo.pop()
            if id(own) in seen or (own.marked and not again):
                continue
            seen.add(id(own))
            own.marked = own.marked or not again
            for p in own.parts:
                if isinstance(p, Value):
                    todo.append(p)
                else:
                    yield p


def literal_score(value: str) -> float:
    """The score of one literal."""
    return Value((value, 0, len(value))).score()


@functools.cache
def _lexer(unclosed: str) -> re.Pattern[str]:
    """Tokens of a line in which the quotes in ``unclosed`` open no string."""
    quotes = [q for q in _STRINGS if q not in unclosed]
    return re.compile(
        rf"""(?P<comment>(?<!\S)(?://|\#).*)
        {"|(?P<string>" + "|".join(_STRINGS[q] for q in quotes) + ")" if quotes else ""}
        {"|(?P<open>" + "|".join(_OPENS[q] for q in quotes) + ")" if quotes else ""}
        |(?P<bind>:=|=>|[=:](?![=:/]))
        |(?P<name>[A-Za-z_][\w]*(?:[.-][A-Za-z_]\w*)*)
        |(?P<number>\d[\w.]*)
        |(?P<join>\+|\.)
        |(?P<compare>[=!<>]=|[<>])
        |(?P<end>[;,\n{{}}()\[\]])
        |(?P<other>[^\S\n]+|.)""",
        re.X,
    )


def _tokens(text: str, at: int, end: int) -> Iterator[re.Match[str]]:
    """Tokens of the line from ``at`` to ``end``, in time linear in its length.

    A quote that nothing closes opens no string, nor does any later one of its kind: each is looked for once.  A string that ends in
    a bind, with more text right behind it, begins at a stray quote: its closing quote is the one that opens.
    """
    unclosed = ""
    while True:
        for m in _lexer(unclosed).finditer(text, at, end):
            if m.lastgroup == "open":
                unclosed, at = unclosed + m[0], m.end()
                break
            if m.lastgroup == "string" and m.end() < end and text[m.end()] not in _AFTER_STRING and (name := _bound(m[0][1:-1])) is not None:
                # escaped quotes would be tried again from each of them: then only the name is lexed
                at = m.start() + 1 + (name if "\\" in m[0] else 0)
                break
            yield m
        else:
            return


def _bound(inside: str) -> int | None:
    """Where the name begins that a bind at the end of ``inside`` follows, if there is one."""
    name = (left := inside.rstrip()).rstrip("=:>").rstrip()
    if len(name) == len(left) or not left.endswith(("=", ":", "=>")) or left.endswith("=="):
        return None
    start = len(name)
    while start and (name[start - 1].isalnum() or name[start - 1] in "_.-"):
        start -= 1
    return start


def lexed_values(text: str) -> Iterator[tuple[str, Value]]:
    """(target name, its value) for each name that gets literals, directly or by way of other names, in order of the text."""
    known: dict[str, Value] = {}
    out: list[tuple[str, Value]] = []
    last = target = ""
    got = Value()

    def give(name: str, value: Value) -> None:
        known[name.lower()] = value
        out.append((name, value))

    def close() -> None:
        nonlocal target, got
        if target and got.parts:
            give(target, got)
        if got.parts or target:
            got = Value()
        target = ""

    triples = _triples(text)
    following = next(triples, None)
    # assignments are lexed in the lines that have one, each as a whole
    for at, stop in _lines(text):
        while following and following[1] < at:
            give(following[0], following[2])
            following = next(triples, None)
        last = ""
        bare = _bare(text, at, stop, known)
        for m in _tokens(text, at, stop):
            kind, word = m.lastgroup, m[0]
            if bare and m.start() >= bare[0]:
                if m.start() < bare[1] and target:
                    if not got.parts:
                        got.parts.append((text[slice(*bare)], *bare))
                    continue
                close()
                bare, last = None, ""
            if kind == "bind":
                close()
                target = last
            elif kind == "string":
                if target:
                    got.parts.append((word[1:-1], m.start() + 1, m.end() - 1))
                else:
                    last = word[1:-1]  # a quoted key, as in JSON
            elif kind == "name":
                if target and (value := known.get(word.lower())) is not None:
                    got.parts.append(value)
                last = word
            elif kind in ("end", "comment", "compare"):
                close()
                last = "" if kind != "end" or word != "]" else last
        close()
        yield from out
        out.clear()
    while following:
        give(following[0], following[2])
        following = next(triples, None)
    yield from out


def lexed_pairs(text: str) -> list[tuple[str, str, int, int]]:
    """(target name, its whole value, start, end) for each literal of ``lexed_values``: as long as all values written out."""
    out = []
    for name, value in lexed_values(text):
        own = sorted(value.spans(), key=lambda p: p[1])
        whole = "".join(p[0] for p in own)
        out += [(name, whole, start, end) for _, start, end in own]
    return out


def _triples(text: str) -> Iterator[tuple[str, int, Value]]:
    """(name, end, value) of each string in triple quotes that is bound to a name.

    The value has the lines without white space around them and without the dashed lines of a key block; its span is the whole string.
    """
    at, unclosed = 0, ""
    while m := _TRIPLE.search(text, at):
        close = -1 if m[0] in unclosed else text.find(m[0], m.end())
        if close < 0:
            unclosed, at = unclosed + m[0] + " ", m.end()
            if len(unclosed) > 4:  # both kinds
                return
            continue
        before = text[max(at, text.rfind("\n", at, m.start()) + 1) : m.start()]
        before = before[: len(before) - len(_PREFIX.search(before)[0])]
        if (name := _bound(before)) is not None:
            inside = text[m.end() : close]
            lines = [x for line in inside.split("\n") if (x := line.strip()) and not _DASHED.fullmatch(x)]
            start = m.end() + len(inside) - len(inside.lstrip())
            value = Value(("".join(lines), start, max(start, m.end() + len(inside.rstrip()))))
            yield before[name:].split("=")[0].split(":")[0].strip().strip("\"'"), close, value
        at = close + 3


def _bare(text: str, at: int, stop: int, known: dict[str, Value]) -> tuple[int, int] | None:
    """(start, end) of the bare literal that the line from ``at`` to ``stop`` gives to the name it begins with.

    None for names that are known, paths of names, words that are spelled as the name of a secret (access_key = access_key),
    calls, references such as $NAME, and operands.
    """
    if not (m := _BARE.match(text, at, stop)):
        return None
    value = m["value"].rstrip(";")
    if m.start("value") > m.end("bind") and value.startswith(("#", "//")):
        return None  # a comment
    if not value or value.lower() in known or _CALL.match(value) or _REFERENCE.match(value) or _EXPRESSION.match(text, m.end(), stop):
        return None
    if not any(c.isdigit() for c in value) and (_PATH.fullmatch(value) or (_WORD.fullmatch(value) and sensitivity(value))):
        return None
    return m.start("value"), m.start("value") + len(value)


def _lines(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each line that may bind a name."""
    end = 0
    while m := _BIND.search(text, end):
        start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
        end = len(text) if end < 0 else end
        yield start, end


def lexed_spans(text: str, threshold: float = 0.5) -> list[tuple[int, int, str]]:
    """Literals whose best target name and whole value together reach ``threshold``."""
    found: dict[tuple[int, int], None] = {}
    for name, value in lexed_values(text):
        if (weight := sensitivity(name)) and weight * value.score() >= threshold:
            found |= dict.fromkeys((start, end) for _, start, end in value.spans(again=False) if start < end)
    return [(start, end, "assign") for start, end in found]


def _hinted(text: str) -> bool:
    lower = text.lower()
    return any(h in lower for h in _HINTS)


def apart(spans: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those of ``spans`` that overlap none of ``base`` (sorted by start)."""
    merged: list[list[int]] = []
    for start, end, _ in base:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    starts = [m[0] for m in merged]
    return [s for s in spans if not (i := bisect.bisect_left(starts, s[1])) or merged[i - 1][1] <= s[0]]


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and all spans: those of the lexer join where they overlap none of the base.  Each sorted."""
    if not text:
        return [], []
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(base_spans(text), key=order)
    more = []
    if _BIND.search(text) and _hinted(text):
        more = apart(lexed_spans(text), base)
    return base, sorted(base + more, key=order)


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
SPAN_SQL = "array<struct<start:int,end:int,kind:string>>"


def find_secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("base_spans", "spans")) -> DataFrame:
    """``keep`` (default: all columns but the new ones), then base_spans and spans (or ``names``): arrays of start, end, kind.

    Offsets are in code points, end exclusive.  Null and empty texts have no spans; very long ones are scanned whole.  Ties: spans
    of one start are in the order of KINDS.  Rows that repeat are scanned each for itself; an empty table gives no rows.  Columns of ``df`` with
    the names of the new ones are replaced.
    """
    keep = [c for c in df.columns if c not in names] if keep is None else keep

    def run(texts: list[str | None]) -> list[list]:
        found = [scan(t) for t in texts]
        return [[[dict(zip(("start", "end", "kind"), s, strict=True)) for s in f[i]] for f in found] for i in (0, 1)]

    return map_rows(df, run, [text], [(n, SPAN, SPAN_SQL) for n in names], keep)


def spelled(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def masked(df: DataFrame, text: str = "text", spans: str = "spans", mask: str = "[SECRET]") -> DataFrame:
    """``text`` with every span replaced by ``mask``; overlapping spans become one.  ``spans`` is dropped.  Null stays null."""
    start = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        ),
    )
    end = F.lit(2**31 - 1)
    shown = df.withColumn("__masked", F.when(F.size(spans) > 0, start))
    value = F.when(F.col("__masked").isNull(), F.col(text)).otherwise(F.concat(F.col("__masked.out"), F.substring(F.col(text), F.col("__masked.at") + 1, end)))
    return shown.withColumn(text, value).drop("__masked", spans)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, digest of the base spans, all spans."""
    found = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(spelled("base_spans").cast("binary"), 256).alias("base_sha256"), spelled("spans").alias("spans"))
