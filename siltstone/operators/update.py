"""What has changed between a corpus and the stored files, and new ids in path order."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.files import index_reason, stat_reason, unchanged_by_stat
from ..shared import checkpointed
from ..sources.corpus import Corpus, as_corpus

FILES = "file_id long, path string, mtime_ns long, size long, content_hash long"


def indexable(corpus: DataFrame) -> DataFrame:
    """The corpus with ``reason``; rows other than ok are not indexed."""
    return corpus.withColumn("reason", index_reason(F.col("path"), F.col("size"), F.col("content")))


def _below(paths: DataFrame, failed: DataFrame) -> DataFrame:
    """The paths that are, or lie below, one of ``failed``."""
    parts = F.split("path", "/")
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("above"))
    return above.join(failed.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()


def diff(corpus: Corpus | DataFrame, files: DataFrame, rejected: DataFrame | None = None, entries: DataFrame | None = None, keep_unlisted: bool = True) -> DataFrame:
    """(path, status, by, reason, known, moved, listed, file_id, mtime_ns, size, content_hash) of all listed or known paths.

    ``files`` and ``rejected`` (path, mtime_ns, size, reason) are what the index knows; ``entries`` a
    listing made before. The outer join moves metadata only. Content is read for files whose
    stat differs from what is known, and that their name and size don't rule out. Status is
    added, changed, removed, unchanged, ignored (listed, not indexable, not stored) or forgotten
    (rejected once, no longer listed). ``by`` says how: listing, stat, content, or unlisted: stored files below a folder that could not
    be listed count as unchanged with ``keep_unlisted``, else as removed. ``moved`` rows differ
    from what is known.
    """
    corpus = as_corpus(corpus)
    entries = checkpointed(corpus.entries()) if entries is None else entries
    before = [F.col("mtime_ns").alias("old_mtime"), F.col("size").alias("old_size")]
    old = files.select("path", "file_id", *before, F.col("content_hash").alias("old_hash"), F.lit(None).cast("string").alias("old_reason"), F.lit(True).alias("stored"))
    if rejected is not None:
        old = old.unionByName(rejected.select("path", *before, F.col("reason").alias("old_reason"), F.lit(False).alias("stored")), allowMissingColumns=True)
    new = entries.filter("kind = 'file'").select("path", "mtime_ns", "size", F.lit(True).alias("listed"))
    same = F.coalesce(unchanged_by_stat(F.col("mtime_ns"), F.col("size"), F.col("old_mtime"), F.col("old_size")), F.lit(False))
    both = new.join(old, "path", "full_outer").withColumn("same", same).withColumn("by_name", stat_reason(F.col("path"), F.col("size")))
    both = checkpointed(both.withColumn("known", F.col("stored").isNotNull()).fillna(False, ["listed", "stored"]))
    failed = entries.filter("kind = 'unreadable'")
    if keep_unlisted and not failed.isEmpty():
        both = both.join(_below(both.filter("stored and not listed"), failed).withColumn("unlisted", F.lit(True)), "path", "left").fillna(False, ["unlisted"])
    else:
        both = both.withColumn("unlisted", F.lit(False))
    read = corpus.judged(both.filter("listed and not same and by_name is null").select("path", "mtime_ns", "size"))
    seen = both.join(read.select("path", "reason", F.xxhash64("content").alias("content_hash")), "path", "left")
    reason = F.when(F.col("same"), F.coalesce("old_reason", F.lit("ok"))).when(F.col("listed"), F.coalesce("by_name", "reason", F.lit("unreadable")))
    seen = seen.withColumn("reason", reason)
    status = (
        F.when(F.col("unlisted"), "unchanged")
        .when(~F.col("listed"), F.when(F.col("stored"), "removed").otherwise("forgotten"))
        .when(F.col("same"), F.when(F.col("stored"), "unchanged").otherwise("ignored"))
        .when(F.col("reason") != "ok", F.when(F.col("stored"), "removed").otherwise("ignored"))
        .when(~F.col("stored"), "added")
        .when(F.col("content_hash") == F.col("old_hash"), "unchanged")
        .otherwise("changed")
    )
    by = F.when(F.col("unlisted"), "unlisted").when(~F.col("listed"), "listing").when(F.col("same"), "stat").when(F.col("by_name").isNotNull(), "listing").otherwise("content")
    kept = F.col("same") | F.col("unlisted")
    columns = [F.coalesce(f"{new}", old).alias(new) for new, old in (("mtime_ns", "old_mtime"), ("size", "old_size"))]
    return seen.select("path", status.alias("status"), by.alias("by"), "reason", "known", (~kept).alias("moved"), "listed", "file_id", *columns, F.when(kept, F.col("old_hash")).otherwise(F.col("content_hash")).alias("content_hash"))


def counts(changes: DataFrame) -> DataFrame:
    """One row: added, changed, removed, unchanged."""
    return changes.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "changed", "removed", "unchanged")])


def with_ids(rows: DataFrame, after: int, order: str = "path") -> DataFrame:
    """``rows`` with ``file_id`` = after + 1, after + 2, ... in the order of a column.

    Rows are sorted by range partitions; a partition's ids start after the counts of the
    partitions before it, so no task sees all rows. The driver gets one count for each of the
    ``spark.sql.shuffle.partitions``.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, order).sortWithinPartitions(order)
    at = F.monotonically_increasing_id()
    placed = checkpointed(ranged.withColumn("__p", F.shiftright(at, 33)).withColumn("__k", at.bitwiseAND((1 << 33) - 1)))
    sizes = {r["__p"]: r["n"] for r in placed.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    # the first id of every partition, empty ones too
    starts = itertools.accumulate((sizes.get(k, 0) for k in range(max(sizes, default=0))), initial=after + 1)
    first = F.array(*[F.lit(n).cast("long") for n in starts])
    return placed.withColumn("file_id", F.get(first, F.col("__p").cast("int")) + F.col("__k")).drop("__p", "__k")


def lists_rewritten(gained: DataFrame) -> DataFrame:
    """One row: how many trigrams' lists gain at least one id, of new pairs or lists."""
    return gained.agg(F.count_distinct("trigram").alias("trigrams_rewritten"))
