"""Quality rules with risk-controlled thresholds (operator 4), with DataFrame operations only.

Each rule rejects texts whose measure exceeds a cutoff.  Rule sets form one sequence, each stricter than the one before: rules
join one after the other, from their loosest cutoff to their tightest.  Labelled bad documents order the rules, by how many of them a rule
rejects; labelled good documents, which have no part in that, say how many good ones each rule set rejects.  An exact binomial
bound (Clopper and Pearson) on the share of good documents that all rules together reject must stay below ``risk``.

The bound is asked for each language (the stratum) and for all of them together.  Families with too few labels to certify
anything are left out beforehand; the level is divided among the others (Bonferroni), and within one the sequence is tested from its
loosest rule set on until the first that fails, which needs no further correction.  A language without a certificate of its own takes the
rule set of all languages, unless its own labels show a larger share than ``risk``: then only the base rejects there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import checkpointed, table, text_or_empty

#: Parameters: tolerated share of good documents that all rules together reject, confidence, steps of a grid.
RISK, CONFIDENCE, GRID = 0.01, 0.95, 24
#: Fixed values: characters that are symbols, words of a repeated window.
SYMBOLS, REPEAT = "#*$%&|<>", 8
#: Rules by measure: the loosest and the tightest cutoff of the grid.
RULES = {
    "symbol_share": (1.0, 0.05),
    "dup_line_share": (1.0, 0.2),
    "repeat_share": (0.30, 0.05),
    "upper_share": (1.0, 0.2),
    "mean_word_length": (40.0, 9.0),
    "shout_share": (1.0, 0.1),
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeated(own: Column) -> Column:
    """Words inside windows of 8 words that occur twice or more, the first occurrence included.

    Most texts repeat no window, which the number of distinct hashes tells.  In the others windows are sorted by hash and place, so that equal ones are
    neighbours; their places are sorted again, and each covers 8 words or those up to the next place.
    """
    # an array around an array names it inside the lambda that follows, so that it is made once
    words_hashed = F.array(F.transform(own, lambda w: F.xxhash64(w)))
    wide = F.flatten(F.transform(words_hashed, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, REPEAT)]))))
    hashes = F.slice(wide, 1, F.size(own) - (REPEAT - 1))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = F.flatten(F.transform(F.array(pairs), lambda p: F.filter(F.transform(p, lambda x, j: F.when((F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull())))
        at = F.flatten(F.transform(F.array(F.array_sort(twice)), lambda p: F.transform(p, lambda x, j: F.least(F.lit(REPEAT), F.coalesce(F.get(p, j + 1) - x, F.lit(REPEAT))))))
        return F.aggregate(at, F.lit(0).cast("long"), lambda a, x: a + x)

    count = F.aggregate(F.array(hashes), F.lit(0).cast("long"), lambda a, h: a + F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(own) > REPEAT, count).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, then the base measures and those of the rules, of whole texts; null is an empty text."""
    text = F.col("__t")
    only = lambda chars: F.char_length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")  # noqa: E731
    own = docs.select(*keep, text_or_empty().alias("__t")).withColumn("__w", words(text)).withColumn("__l", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    own = own.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.aggregate("__w", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        only(SYMBOLS).alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeated(F.col("__w")).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        only("A-Z").alias("n_upper"),
        only("!?").alias("n_shouts"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))  # noqa: E731
    return own.select(
        "*",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("word_chars", "n_words").alias("mean_word_length"),
        share("n_shouts", "word_chars").alias("shout_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def upper_bound(bad: int, n: int, alpha: float) -> float:
    """Clopper and Pearson's upper limit of a share of which ``bad`` of ``n`` were seen, at level 1 - alpha."""
    if bad >= n:
        return 1.0
    logs = log_combinations(bad, n)
    low, high = bad / n, 1.0
    for _ in range(50):
        p = (low + high) / 2
        low, high = (p, high) if tail(logs, n, p) > alpha else (low, p)
    return high


def log_combinations(bad: int, n: int) -> list[float]:
    return [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(bad + 1)]


def tail(logs: list[float], n: int, p: float) -> float:
    """How probable at most as many of ``n`` are as ``logs`` reaches, at a share ``p``."""
    terms = [c + k * math.log(p) + (n - k) * math.log1p(-p) for k, c in enumerate(logs)]
    top = max(terms)
    return math.exp(top) * sum(math.exp(t - top) for t in terms)


def certified(bad: int, n: int, alpha: float, risk: float) -> bool:
    """Whether the upper bound is at most ``risk``, by one sum instead of the search for the bound: labels may be millions."""
    return bad < risk * n and tail(log_combinations(bad, n), n, risk) <= alpha


def grid(rule: str, steps: int = GRID) -> list[float]:
    loose, tight = RULES[rule]
    return [loose + (tight - loose) * i / (steps - 1) for i in range(steps)]


#: The family of all languages together; a stratum is a string.
POOL = None


def strictness(order: list[str]) -> Column:
    """Place in the sequence of the first rule set that rejects a row; as many as there are rule sets if none does."""
    first = lambda k, r: F.array_position(F.transform(F.array(*map(F.lit, grid(r))), lambda c: F.col(r) > c), True)  # noqa: E731
    places = [F.when(p > 0, k * GRID + p - 1) for k, p in enumerate(first(k, r) for k, r in enumerate(order))]
    return F.coalesce(F.least(*places), F.lit(GRID * len(order)))


def rule_order(measured: DataFrame) -> list[str]:
    """Rules by how many labelled bad rows the tightest cutoff rejects, then as listed."""
    bad = measured.where((F.col("quality") != 1) & ~base_failed())
    caught = bad.agg(*[F.count(F.when(F.col(r) > grid(r)[-1], 1)).alias(r) for r in RULES]).first()
    return sorted(RULES, key=lambda r: -caught[r])


def certified_sets(measured: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> tuple[list[str], dict[str | None, int], set[str]]:
    """(order of the rules, place of the strictest certified rule set by family, strata that must not take that of all).

    One aggregation counts, for each stratum, the good rows by the first rule set that rejects them; only strata that can be certified,
    and sums of the others, come to the driver.
    """
    order = rule_order(measured)
    last = GRID * len(order)
    good = measured.where((F.col("quality") == 1) & ~base_failed()).where(F.col("stratum").isNotNull())
    counts = checkpointed(good.groupBy("stratum", strictness(order).alias("level")).agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.groupBy("stratum").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    least = math.floor(math.log1p(-confidence) / math.log1p(-risk))  # fewer can't be certified at any number of families
    families = sorted([(POOL, total), *[(r["stratum"], r["n"]) for r in sizes.where(F.col("n") >= least).collect()]], key=lambda f: -f[1])
    level = lambda m: (1 - confidence) / m  # noqa: E731
    families = [f for m, f in enumerate(families, 1) if certified(0, f[1], level(m), risk)]
    levels: dict[str | None, list[int]] = {f: [0] * (last + 1) for f, _ in families}
    for row in counts.groupBy("level").agg(F.sum("n").alias("n")).collect():
        if POOL in levels:
            levels[POOL][row["level"]] = row["n"]
    own = [f for f, _ in families if f is not POOL]
    for row in counts.where(F.col("stratum").isin(own)).collect() if own else ():
        levels[row["stratum"]][row["level"]] = row["n"]
    found: dict[str | None, int] = {}
    for family, n in families:
        rejected = 0
        for place in range(last):
            rejected += levels[family][place]
            if not certified(rejected, n, level(len(families)), risk):
                break
            found[family] = place
    against: set[str] = set()
    if POOL in found:
        shares = counts.groupBy("stratum").agg(F.sum(F.when(F.col("level") <= found[POOL], F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("n"))
        against = {r["stratum"] for r in shares.where(F.col("bad") > risk * F.col("n")).collect()} - set(found)
    return order, found, against


def cutoffs(order: list[str], place: int) -> dict[str, float]:
    """Cutoffs of a rule set: the tightest of rules before the last one, which has its own."""
    k, i = divmod(place, GRID)
    return {r: grid(r)[i if j == k else -1] for j, r in enumerate(order[: k + 1])}


def calibrate(measured: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> dict[tuple[str, str], float]:
    """Cutoffs by (stratum, rule) from labelled rows (stratum, quality with 1 for good, and the measures), of strata certified by themselves."""
    order, found, _ = certified_sets(measured, risk, confidence)
    return {(s, r): c for s, place in found.items() if s is not POOL for r, c in cutoffs(order, place).items()}


def judge(measured: DataFrame, sets: tuple[list[str], dict[str | None, int], set[str]]) -> DataFrame:
    """``measured`` (with stratum) and the columns base_failed, rejected_by (rules, an array), kept."""
    order, found, against = sets
    own = sorted(s for s in found if s is not POOL)
    rejected = [F.when((F.col("stratum") == s) & (F.col(r) > c), F.lit(r)) for s in own for r, c in cutoffs(order, found[s]).items()]
    if POOL in found:
        others = F.col("stratum").isNotNull()
        if names := [*own, *sorted(against)]:
            others = others & ~F.col("stratum").isin(names)
        rejected += [F.when(others & (F.col(r) > c), F.lit(r)) for r, c in cutoffs(order, found[POOL]).items()]
    by = F.array_sort(F.array_compact(F.array(*rejected))) if rejected else F.array().cast("array<string>")
    return measured.withColumn("base_failed", base_failed()).withColumn("rejected_by", by).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def labelled(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """What the cutoffs need of every labelled row of ``measured`` (with doc_id, stratum), with quality."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return measured.select("doc_id", "stratum", "n_words", "n_repeat_words", *RULES).join(known, "doc_id")


#: Columns that the operator adds.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", *RULES, "base_failed", "rejected_by", "kept")


def quality_rules(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: doc_id) and all measures and verdicts of each row of ``docs`` (doc_id, text, lang).

    Null and empty texts have no words and fail the base; very long ones are measured whole.  A null language has no cutoffs.
    Without labels only the base rejects.  Ties: a measure equal to a cutoff is not beyond it.  Rows that repeat are judged each for itself;
    an empty table gives no rows.  Kept columns with the names of new ones (``ADDED``) are replaced.
    """
    keep = ["doc_id"] if keep is None else keep
    carried = [c for c in keep if c not in ADDED]
    inner = {c: f"__k{i}" for i, c in enumerate(carried)}
    chosen = docs.select("doc_id", "text", F.col("lang").alias("stratum"), *[F.col(f"`{c}`").alias(n) for c, n in inner.items()])
    # measured once: for the cutoffs, then for the verdicts
    measured = checkpointed(measures(chosen, ["doc_id", "stratum", *inner.values()]))
    judged = judge(measured, certified_sets(labelled(measured, labels)))
    return judged.select(*[F.col(n).alias(c) for c, n in inner.items()], *ADDED)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document."""
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The same in DuckDB's SQL: measures, order of the rules, families, sequence of rule sets and verdicts."""
    names, last = list(RULES), GRID * len(RULES)
    cuts = ", ".join(f"('{r}', {i}, {c!r}::DOUBLE)" for r in names for i, c in enumerate(grid(r)))
    tight = ", ".join(f"(SELECT count(*) FILTER (WHERE {r} > {grid(r)[-1]!r}::DOUBLE) FROM bad) AS {r}" for r in names)
    order = ", ".join(f"('{r}', {k}, (SELECT {r} FROM caught))" for k, r in enumerate(names))
    wide = lambda source: " UNION ALL ".join(f"SELECT rid, '{r}' AS rule, {r} AS v FROM {source}" for r in names)  # noqa: E731
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END"  # noqa: E731
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ 	-]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS l FROM t),
win AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1) GROUP BY rid),
m AS (SELECT w.rid, doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!?]', '', 'g')) AS n_shouts
      FROM w LEFT JOIN rep ON w.rid = rep.rid),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {share('n_symbols', 'word_chars')} AS symbol_share, {share('n_dup_lines', 'n_lines')} AS dup_line_share, {share('n_repeat_words', 'n_words')} AS repeat_share,
      {share('n_upper', 'word_chars')} AS upper_share, {share('word_chars', 'n_words')} AS mean_word_length, {share('n_shouts', 'word_chars')} AS shout_share FROM m),
known AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
lab AS (SELECT s.*, quality FROM s JOIN known USING (doc_id) WHERE NOT base_failed),
bad AS (SELECT * FROM lab WHERE quality <> 1),
caught AS (SELECT {tight}),
ord AS (SELECT rule, row_number() OVER (ORDER BY n DESC, k) - 1 AS k FROM (VALUES {order}) AS o(rule, k, n)),
cuts AS (SELECT ord.rule, ord.k * {GRID} + i AS place, c FROM (VALUES {cuts}) AS c(rule, i, c) JOIN ord ON ord.rule = c.rule),
wide AS ({wide('s')}),
level AS (SELECT rid, min(place) AS level FROM wide JOIN cuts ON wide.rule = cuts.rule AND v > c GROUP BY rid),
good AS (SELECT lab.rid, lang, coalesce(level, {last}) AS level FROM lab LEFT JOIN level ON lab.rid = level.rid WHERE quality = 1 AND lang IS NOT NULL),
fam AS (SELECT lang AS family, false AS pool, count(*) AS n FROM good GROUP BY lang UNION ALL SELECT '', true, count(*) FROM good),
able AS (SELECT family, pool, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, pool DESC, family) AS m FROM fam) WHERE n > 0 AND n * ln(1 - {RISK}) <= ln({1 - CONFIDENCE} / m)),
cum AS (SELECT family, pool, n, place, (SELECT count(*) FROM good WHERE (able.pool OR good.lang = able.family) AND level <= place) AS bad FROM able, range({last}) AS p(place)),
ok AS (SELECT *, CASE WHEN bad < {RISK} * n THEN list_sum([exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({RISK}) + (n - k) * ln(1 - {RISK})) FOR k IN range(0, bad + 1)]) <= {1 - CONFIDENCE} / (SELECT count(*) FROM able) ELSE false END AS yes FROM cum),
best AS (SELECT family, pool, coalesce(min(place) FILTER (WHERE NOT yes), {last}) - 1 AS place FROM ok GROUP BY family, pool),
against AS (SELECT lang FROM good, best WHERE pool AND lang NOT IN (SELECT family FROM best WHERE NOT pool AND place >= 0) GROUP BY lang, place HAVING count(*) FILTER (WHERE level <= place) > {RISK} * count(*)),
sets AS (SELECT s.rid, CASE WHEN own.place >= 0 THEN own.place WHEN s.lang IS NOT NULL AND s.lang NOT IN (SELECT lang FROM against) THEN (SELECT place FROM best WHERE pool) END AS place
         FROM s LEFT JOIN best AS own ON NOT own.pool AND own.family = s.lang)
SELECT s.doc_id, cast(n_words AS BIGINT) AS n_words, word_chars, cast(n_symbols AS BIGINT) AS n_symbols, cast(n_dup_lines AS BIGINT) AS n_dup_lines, cast(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(level.level <= sets.place, false) AS kept FROM s JOIN sets ON s.rid = sets.rid LEFT JOIN level ON s.rid = level.rid
"""


OP4_SQL = _sql()
