"""Mixing sources to target weights by hierarchical budgets (operator 8).

The tree has a level for each of ``levels``. From the root down, a node's token budget is
dealt to its children in proportion to their weights, but no child gets more than its
capacity (its tokens times ``max_epochs``); what it cannot take goes to its siblings,
and only what a whole subtree cannot take goes to the subtree's own siblings. A leaf
then repeats all its documents for the full epochs in its budget and takes, in the
seeded order of one more epoch, the longest prefix of documents that fits in the rest.

The prefix needs no sort of a leaf: tokens are summed over 4096 ranges of the order's
hash, whole ranges below the budget are taken, and only the range in which the budget
ends is ordered document by document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, table


@dataclass(frozen=True)
class Mix:
    """Integer weights by level and node (1 where not given), budget in percent of all tokens."""

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"domain": {"web": 3, "curated": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}})
    budget_percent: int = 60
    max_epochs: int = 2
    seed: str = "mix-1"


def web_or_curated(source: Column) -> Column:
    """The domain level of the driver's tables: sources with one digit are web crawls."""
    return F.when(source.rlike("^src[0-9]$"), "web").otherwise("curated")


def _weight(level: str, mix: Mix) -> Column:
    out = F.lit(1)
    for node, weight in mix.weights.get(level, {}).items():
        out = F.when(F.col(level) == node, weight).otherwise(out)
    return out.cast("long")


def leaf_budgets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """Leaf sizes (levels, size) -> (levels, size, budget), tokens that are dealt in whole numbers."""
    leaves = sizes.withColumn("cap", F.col("size") * mix.max_epochs)
    above: list[str] = []
    dealt = None
    for level in mix.levels:
        nodes = leaves.groupBy(*above, level).agg(F.sum("cap").alias("cap"), F.sum("size").alias("size")).withColumn("w", _weight(level, mix))
        family = Window.partitionBy(*above)
        if dealt is None:
            nodes = nodes.withColumn("budget", F.floor(F.sum("size").over(family) * mix.budget_percent / 100).cast("long"))
        else:
            nodes = nodes.join(dealt, above)
        # siblings in the order in which they fill up
        order = family.orderBy(F.col("cap") / F.col("w"), level)
        nodes = nodes.withColumn("rest", F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        nodes = nodes.withColumn("weights", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        full = F.col("cap") * F.col("weights") <= F.col("w") * F.col("rest")
        first = F.min(F.when(~full, F.struct(F.col("cap") / F.col("w"), level, "rest", "weights"))).over(family)
        nodes = nodes.withColumn("full", full).withColumn("first", first)
        share = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("w * first.rest div first.weights"))
        above = [*above, level]
        dealt = nodes.select(*above, share.alias("budget"))
    return leaves.join(dealt, above).select(*mix.levels, "size", "budget")


def select_mix(docs: DataFrame, mix: Mix, key: str = "doc_id", text: str = "text", domain: Column | None = None) -> DataFrame:
    """(key, text_hash, *levels, n_tokens, copies): the documents taken, and how often.

    A token is a word. Null texts have none; null level values join the node ''. ``domain``
    is the expression for the level of that name, else levels are columns of ``docs``.
    Rows that repeat key and text are each a document of their own, next to one another in
    the order, and may be split only by the budget's end. Rows with a null key are placed by their text.
    """
    value = {c: F.coalesce((domain if c == "domain" and domain is not None else F.col(c)).cast("string"), F.lit("")).alias(c) for c in mix.levels}
    tokens = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD + "+")).cast("long")
    rows = checkpointed(docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("text_hash"), *value.values(), tokens.alias("n_tokens")))
    levels = list(mix.levels)
    sizes = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("size")).filter("size > 0")
    plan = leaf_budgets(sizes, mix).withColumn("full", F.expr("budget div size")).withColumn("rest", F.expr("budget % size"))
    rows = rows.join(plan, levels).withColumn("order", F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("full") + 1, F.coalesce(F.col("__key").cast("string"), F.concat(F.lit("null "), "text_hash")))))
    rows = rows.withColumn("range", F.substring("order", 1, 3))
    sums = rows.groupBy(*levels, "range").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("r"))
    upto = F.sum("t").over(Window.partitionBy(*levels).orderBy("range"))
    ranges = sums.withColumn("upto", upto).select(*levels, "range", (F.col("upto") <= F.col("r")).alias("whole"), (F.col("upto") - F.col("t")).alias("before")).filter("whole or before <= r")
    rows = rows.join(ranges, [*levels, "range"], "left")
    edge = rows.filter("not whole").withColumn("run", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*levels, "range").orderBy("order", "text_hash").rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("copies", F.col("full") + F.when(F.col("run") <= F.col("rest"), 1).otherwise(0))
    sure = rows.filter("whole is null or whole").withColumn("copies", F.col("full") + F.when(F.col("whole"), 1).otherwise(0))
    columns = [F.col("__key").alias(key), "text_hash", *levels, "n_tokens", "copies"]
    return sure.select(*columns).union(edge.select(*columns)).filter("copies > 0")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fifths of all tokens, dealt over domains, languages and sources; a row for each epoch of a document."""
    taken = select_mix(table(spark, sf_dir, "documents"), Mix(), domain=web_or_curated(F.col("source")))
    return taken.select("doc_id", "domain", "lang", "source", "n_tokens", F.explode(F.expr("sequence(1L, copies)")).alias("epoch"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: four fifths of the tokens that came this far, each document once at most.

    Rows that repeat key and text stay or go together: if the budget ends between them, all stay.
    """
    taken = select_mix(docs, Mix(budget_percent=80, max_epochs=1), domain=web_or_curated(F.col("source"))).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"))
    return docs.join(taken, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__h") == F.xxhash64("text")), "left_semi")


def _level_sql(above: list[str], level: str, parent: str, weight: str) -> str:
    keys = ", ".join(above)
    on = " AND ".join(f"n.{c} = p.{c}" for c in above)
    return f"""
{level}_n AS (SELECT n.*, p.budget, {weight} AS w FROM (SELECT {keys}, {level}, sum(cap)::BIGINT AS cap FROM leaves GROUP BY ALL) n JOIN {parent} p ON {on}),
{level}_o AS (SELECT *, budget - coalesce(sum(cap) OVER (PARTITION BY {keys} ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (PARTITION BY {keys} ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {level}_n),
{level}_b AS (SELECT {keys}, {level}, CASE WHEN cap * ws <= w * rest THEN cap ELSE w * (first_value(rest) OVER f) // (first_value(ws) OVER f) END AS budget FROM {level}_o
    WINDOW f AS (PARTITION BY {keys} ORDER BY (cap * ws <= w * rest)::INT, cap::DOUBLE / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


ORACLE = (
    r"""
WITH t AS (SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' ELSE 'curated' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT 0 AS root, domain, lang, source, sum(n_tokens)::BIGINT AS size, 2 * sum(n_tokens)::BIGINT AS cap FROM t GROUP BY ALL HAVING sum(n_tokens) > 0),
top AS (SELECT 0 AS root, floor(sum(size) * 60 / 100)::BIGINT AS budget FROM leaves),"""
    + _level_sql(["root"], "domain", "top", "CASE domain WHEN 'web' THEN 3 ELSE 2 END")
    + ","
    + _level_sql(["root", "domain"], "lang", "domain_b", "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END")
    + ","
    + _level_sql(["root", "domain", "lang"], "source", "lang_b", "1")
    + """,
e AS (SELECT t.*, budget // size AS full_epochs, budget % size AS rest FROM t JOIN source_b USING (domain, lang, source) JOIN leaves USING (domain, lang, source)),
c AS (SELECT *, full_epochs + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('mix-1:' || (full_epochs + 1)::BIGINT || ':' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS copies FROM e)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, copies::BIGINT + 1)) AS epoch FROM c"""
)
