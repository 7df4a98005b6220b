"""Quality rules with risk-controlled thresholds (operator 4, DataFrame functions only).

Each rule is a ratio of which more is worse. For every stratum and rule, cutoffs are
tried from the most lenient to the strictest. A cutoff may be used while the exact
binomial tail says that its false rejection rate on good documents is at most the
rule's share of ``alpha``; the first cutoff that fails ends the sequence. The level of
each test is ``delta`` divided by the number of (stratum, rule) sequences, so with
probability 1 - delta every stratum's false rejection rate is at most ``alpha``
(fixed-sequence testing inside a sequence, Bonferroni over sequences and rules).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, checkpointed, table

#: rule -> (numerator, denominator) among the columns of ``features``; judged if ``RiskRules.cutoffs`` names it
RATIOS = {"symbols": ("n_symbols", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines")}
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class RiskRules:
    """Cutoffs per rule in percent, from lenient to strict; risk and confidence."""

    cutoffs: dict[str, list[int]] = field(default_factory=lambda: {"symbols": [20, 10, 5, 2, 1], "repeats": [45, 40, 35, 30, 25, 20]})
    alpha: float = 0.05
    delta: float = 0.1
    min_words: int = 50
    max_repeat_percent: int = 50


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of ``FEATURES`` (all long) and ``n_lines`` to ``docs``.

    A null text counts as empty. Existing columns of these names are replaced.
    Repeated 3-word windows are compared by 64-bit hashes within one document.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    keep = [c for c in docs.columns if c not in {*FEATURES, "n_lines"}]
    out = docs.select(
        *keep,
        F.transform(words, lambda w: F.xxhash64(w)).alias("__w"),
        F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("__l"),
    )
    out = out.withColumn("__g", F.expr("if(size(__w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])))"))
    # windows with their places, in order of the hash; only where some window occurs twice
    out = out.withColumn("__s", F.expr("if(size(array_distinct(__g)) = size(__g), null, array_sort(transform(__g, (h, i) -> struct(h, i))))"))
    out = out.withColumn(
        "__d",
        F.expr("""if(__s is null, cast(array() as array<int>), sort_array(transform(filter(sequence(0, size(__s) - 1),
            k -> (k > 0 and __s[k].h = __s[k - 1].h) or (k < size(__s) - 1 and __s[k].h = __s[k + 1].h)), k -> __s[k].i)))"""),
    )
    covered = F.expr("""aggregate(__d, struct(0L as n, 0 as upto), (a, i) -> struct(a.n + (i + 3 - greatest(i, a.upto)) as n, i + 3 as upto), a -> a.n)""")
    return out.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
    )


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, shifted by 10 so that it is exact to about 1e-13."""
    x = n.cast("double") + 10
    series = (x + 0.5) * F.log(x) - x + 0.9189385332046728 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    shift = sum((F.log(n.cast("double") + i) for i in range(2, 11)), F.log(n.cast("double") + 1))
    return series - shift


def _binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed downwards from k; 1 where k is not below the mean.

    Terms fall at least geometrically below the mean; the sum stops after
    60 * sqrt(n) + 60 of them, when what is left is below 1e-16 of it.
    """
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    last = F.least(k, (60 * F.sqrt(n.cast("double")) + 60).cast("long"))
    steps = F.when(last >= 1, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(a: Column, j: Column) -> Column:
        t = a["t"] * (k - j + 1).cast("double") * (1 - p) / ((n - k + j).cast("double") * p)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    total = F.aggregate(steps, start, step, lambda a: a["s"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(top * total)


def calibrate(labelled: DataFrame, rules: RiskRules, stratum: str, good: str = "quality") -> DataFrame:
    """Strictest safe cutoff per stratum and rule: (stratum, rule, cutoff).

    ``labelled`` holds ``features`` columns, the stratum and the label (1: good).
    All labelled rows count; a rule without a safe cutoff has no row.
    """
    ok = labelled.filter(F.col(good) == 1).withColumn("stratum", F.col(stratum))
    counts = []
    for rule, cutoffs in rules.cutoffs.items():
        top, bottom = RATIOS[rule]
        counts += [F.count_if(100 * F.col(top) > c * F.col(bottom)).alias(f"{rule}:{c}") for c in cutoffs]
    per = ok.groupBy("stratum").agg(F.count("*").alias("n"), *counts)
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"`{r}:{c}`").alias("k")) for r, cs in rules.cutoffs.items() for i, c in enumerate(cs)])
    level = rules.delta / max(1, per.count() * len(rules.cutoffs))
    tested = per.select("stratum", "n", F.inline(tests))
    safe = _binomial_tail(F.col("n"), F.col("k"), rules.alpha / len(rules.cutoffs)) <= level
    steps = tested.select("stratum", "rule", "step", "cutoff", safe.alias("safe")).groupBy("stratum", "rule")
    passed = steps.agg(F.coalesce(F.min(F.when(~F.col("safe"), F.col("step"))), F.lit(1 << 20)).alias("upto"), F.collect_list(F.struct("step", "cutoff")).alias("all"))
    return passed.select("stratum", "rule", F.expr("array_min(transform(filter(all, x -> x.step < upto), x -> x.cutoff))").alias("cutoff")).filter("cutoff is not null")


def judge(docs: DataFrame, labels: DataFrame, rules: RiskRules | None = None, key: str = "doc_id", stratum: str = "lang", text: str = "text") -> DataFrame:
    """Key, text hash and stratum with FEATURES, ``base_failed`` and ``kept``, one row per row of ``docs``.

    ``labels`` holds ``key`` and ``quality``; rows with a null in either are ignored, and
    a key labelled twice counts twice. Null texts count as empty. A null stratum is a
    stratum of its own. Where no cutoff is safe (few or no labels), only the base rules
    reject. Other columns of ``docs`` are not read, so their names can't clash.
    """
    rules = rules or RiskRules()
    rows = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("text_hash"), F.col(stratum).alias("__stratum"), F.col(text).alias("__text"))
    scored = checkpointed(features(rows, "__text").drop("__text"))
    labelled = scored.join(labels.select(F.col(key).alias("__key"), F.col("quality").alias("__quality")), "__key")
    cut = calibrate(labelled, rules, "__stratum", "__quality")
    cuts = cut.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__cut_{r}") for r in rules.cutoffs])
    out = scored.join(cuts, F.col("__stratum").eqNullSafe(F.col("stratum")), "left")
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    bad = F.lit(False)
    for r in rules.cutoffs:
        top, bottom = RATIOS[r]
        bad = bad | F.coalesce(100 * F.col(top) > F.col(f"__cut_{r}") * F.col(bottom), F.lit(False))
    return out.select(F.col("__key").alias(key), "text_hash", F.col("__stratum").alias("stratum"), *FEATURES, base.alias("base_failed"), (~base & ~bad).alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with cutoffs certified per language on all labelled documents."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *FEATURES, "base_failed", "kept")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that a rule rejects go; rows of one id are told apart by text."""
    verdict = judge(docs, table(spark, sf_dir, "labels")).filter("not kept")
    gone = verdict.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"))
    return docs.join(gone, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__h") == F.xxhash64("text")), "left_anti")


_FEATURES_SQL = r"""
qt AS (SELECT doc_id, text, lang, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
qx AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g,
              unnest(range(1, len(w) - 1)) AS i FROM qt),
qd AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM qx) WHERE c >= 2),
qr AS (SELECT doc_id, sum(least(3, coalesce(nx - i, 3))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM qd) GROUP BY doc_id),
ql AS (SELECT doc_id, text, lang, body, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
              len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols,
              list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM qt),
qf AS (SELECT ql.doc_id, text, lang, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
              (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
       FROM ql LEFT JOIN qr ON ql.doc_id = qr.doc_id),
qg AS (SELECT lang, unnest([struct_pack(rule := 'symbols', num := n_symbols, den := word_chars), struct_pack(rule := 'repeats', num := n_repeat_words, den := n_words)]) AS r
       FROM qf JOIN labels USING (doc_id) WHERE quality = 1),
qc(rule, step, cutoff) AS (VALUES ('symbols', 0, 20), ('symbols', 1, 10), ('symbols', 2, 5), ('symbols', 3, 2), ('symbols', 4, 1),
              ('repeats', 0, 45), ('repeats', 1, 40), ('repeats', 2, 35), ('repeats', 3, 30), ('repeats', 4, 25), ('repeats', 5, 20)),
qk AS (SELECT lang, qc.rule, step, cutoff, count(*) AS n, count(*) FILTER (WHERE 100 * r.num > cutoff * r.den) AS k FROM qg JOIN qc ON qc.rule = r.rule GROUP BY ALL),
qp AS (SELECT *, CASE WHEN k >= n * 0.025 THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - lgamma(n - j + 1) + j * ln(0.025) + (n - j) * ln(0.975)))) END
              <= 0.1 / (2 * (SELECT count(*) FROM (SELECT DISTINCT lang FROM qg))) AS safe FROM qk),
qs AS (SELECT lang, rule, min(cutoff) AS cutoff FROM qp AS a WHERE NOT EXISTS (SELECT 1 FROM qp AS b WHERE b.lang IS NOT DISTINCT FROM a.lang AND b.rule = a.rule AND b.step <= a.step AND NOT b.safe) GROUP BY lang, rule),
qj AS (SELECT qf.*, coalesce(n_words < 50 OR 100 * n_repeat_words > 50 * n_words, false) AS base_failed,
              EXISTS (SELECT 1 FROM qs WHERE qs.lang IS NOT DISTINCT FROM qf.lang AND ((rule = 'symbols' AND 100 * n_symbols > cutoff * word_chars) OR (rule = 'repeats' AND 100 * n_repeat_words > cutoff * n_words))) AS bad FROM qf)
"""

ORACLE = "WITH " + _FEATURES_SQL.format(docs="documents") + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT bad) AS kept FROM qj"
