"""Search: candidates, lines, matches and the shapes in which hits are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import binary_content
from ..functions.text import highlighted, lines, spans, without_cr
from ..plans.pattern import Query, plan
from . import postings as P


def _contains_all(text: Column, query: Query) -> Column:
    """Every required trigram occurs: a filter that needs no index, before lines are split."""
    from ..plans.pattern import required_literals

    out = F.lit(True)
    if query.required:
        for run in required_literals(query.pattern):
            if len(run) >= 3:
                out = out & F.contains(text, F.lit(run.decode()))
    return out


def line_hits(content: DataFrame, query: Query, *extra: Column, prefilter: bool = True) -> DataFrame:
    """Hits of (file_id, path, text): file_id, path, lineno and line, and what ``extra`` makes of ``line``.

    The pattern is tested on each line with its carriage return; the return is not shown.
    """
    some = content.filter(_contains_all(F.col("text"), query)) if prefilter else content
    rows = some.select("file_id", "path", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    found = rows.filter(F.col("line").rlike(query.java))
    return found.select("file_id", "path", (F.col("pos") + 1).alias("lineno"), without_cr(F.col("line")).alias("line"), *extra)


def narrowed(query: Query, postings: DataFrame, stats: DataFrame | None = None, most_trigrams: int = 8) -> DataFrame | None:
    """(file_id) of the only files that can match, by the rarest required trigrams; None if the index can't tell."""
    if not query.required:
        return None
    required = list(query.required)
    if stats is not None and len(required) > most_trigrams:
        required = P.rarest(stats, required, most_trigrams)
    return P.candidates(postings, required) if required is not None else postings.select(F.lit(0).cast("long").alias("file_id")).limit(0)


def search(content: DataFrame, pattern: str, ignore_case: bool = False, postings: DataFrame | None = None, stats: DataFrame | None = None, files: DataFrame | None = None, most_trigrams: int = 8, pushed: int = 1000, with_spans: bool = False) -> DataFrame:
    """Hits in live content (file_id, path, text), narrowed by postings where there are any.

    Bad patterns raise before any data is read. Content that looks binary has no hits, nor
    has content that is not in ``files`` (file_id), where that is given. With few
    candidates their ids are pushed into the content's scan.
    """
    query = plan(pattern, ignore_case, content.sparkSession)
    live = content if files is None else content.join(files.select("file_id"), "file_id", "left_semi")
    chosen = narrowed(query, postings, stats, most_trigrams) if postings is not None else None
    if chosen is not None:
        few = [r[0] for r in chosen.limit(pushed + 1).collect()]
        if len(few) <= pushed:
            live = live.filter(F.col("file_id").isin(few)) if few else live.filter(F.lit(False))
        else:
            live = live.join(chosen, "file_id", "left_semi")
    return hits_in(live, query, with_spans)


def hits_in(content: DataFrame, query: Query, with_spans: bool = False) -> DataFrame:
    """Hits of a plan in (file_id, path, text); content that looks binary has none."""
    extra = [spans(without_cr(F.col("line")), query.java).alias("spans")] if with_spans else []
    return line_hits(content.filter(~binary_content(F.encode("text", "UTF-8"))), query, *extra)


def selectivity(content: DataFrame, patterns: list[str], postings: DataFrame) -> DataFrame:
    """(pattern, required, candidates, matched): how well the index narrows each pattern."""
    spark = content.sparkSession
    out = None
    for pattern in patterns:
        query = plan(pattern, spark=spark)
        n = P.candidates(postings, query.required).agg(F.count("*").alias("candidates")) if query.required else content.agg(F.count("*").alias("candidates"))
        matched = line_hits(content, query).agg(F.count_distinct("file_id").alias("matched"))
        row = n.select(F.lit(pattern).alias("pattern"), F.lit(len(query.required or ())).alias("required"), "candidates").join(matched.select(F.lit(pattern).alias("pattern"), "matched"), "pattern")
        out = row if out is None else out.unionByName(row)
    return out


def hits_per_file(hits: DataFrame) -> DataFrame:
    return hits.groupBy("file_id", "path").agg(F.count("*").alias("n_lines"))


def hit_totals(hits: DataFrame) -> DataFrame:
    """(n_lines, n_files)"""
    return hits.agg(F.count("*").alias("n_lines"), F.count_distinct("file_id").alias("n_files"))


def first_per_file(hits: DataFrame) -> DataFrame:
    """Each file's first hit: its heading."""
    first = hits.groupBy("file_id").agg(F.min(F.struct("lineno", "path", "line")).alias("h"))
    return first.select("file_id", "h.path", "h.lineno", "h.line")


def first_hits(hits: DataFrame, n: int) -> DataFrame:
    """The first n of hits that are there, or are all to be found."""
    return hits.orderBy("file_id", "lineno").limit(n)


def first_hits_of(live: DataFrame, read, query: Query, n: int, first: int = 32, most: int = 8192) -> DataFrame:
    """The first n hits (file_id, path, lineno, line), without reading much more than they are in.

    ``live`` has the candidates (file_id and whatever ``read`` needs), and ``read`` gives content
    (file_id, path, text) of some of them. Candidates are taken by growing ranges of ids, of which the driver
    holds at most ``most``, until n hits are there; the last range is all that is left.
    """
    spark, found, last, size = live.sparkSession, [], None, first
    kind = live.schema["file_id"].dataType.simpleString()
    while len(found) < n:
        rest = live if last is None else live.filter(F.col("file_id") > last)
        some = rest.orderBy("file_id").limit(size).collect() if size <= most else None
        if some is not None and not some:
            break
        hits = hits_in(read(rest if some is None else spark.createDataFrame(some, live.schema)), query)
        found += first_hits(hits, n - len(found)).collect()
        if some is None:
            break
        last, size = some[-1]["file_id"], 16 * size
    return spark.createDataFrame(found, f"file_id {kind}, path string, lineno int, line string")


def in_order(hits: DataFrame) -> DataFrame:
    return hits.orderBy("file_id", "lineno")


def flat_text(hits: DataFrame) -> DataFrame:
    """One string a hit: path:lineno:line."""
    return hits.select(F.concat_ws(":", "path", F.col("lineno").cast("string"), "line").alias("value"))


def grouped_text(hits: DataFrame) -> DataFrame:
    """One block of text a file: its path, then lineno:line for each hit."""
    rows = hits.groupBy("file_id", "path").agg(F.sort_array(F.collect_list(F.struct("lineno", "line"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["lineno"].cast("string"), r["line"])), "\n")
    return rows.select("file_id", "path", F.concat_ws("\n", "path", body).alias("value"))


def highlighted_hits(hits: DataFrame, pattern: str, ignore_case: bool = False, opening: str = "[", closing: str = "]") -> DataFrame:
    return hits.withColumn("shown", highlighted(F.col("line"), plan(pattern, ignore_case).java, opening, closing))


def batch(content: DataFrame, patterns: dict[int, str], postings: DataFrame, stats: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(pattern_id, file_id, n_lines) of a few patterns; for many, see ``batch_table``."""
    from .batch import batch_table

    rows = content.sparkSession.createDataFrame(list(patterns.items()), "pattern_id int, pattern string")
    return batch_table(content, rows, postings, stats, files)


def write_flat(hits: DataFrame, folder: str) -> None:
    flat_text(in_order(hits)).write.mode("overwrite").text(folder)


def write_grouped(hits: DataFrame, folder: str) -> None:
    grouped_text(hits).orderBy("file_id").select("value").write.mode("overwrite").option("lineSep", "\n\n").text(folder)


def content_of(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A table of documents as searchable content, with the key as file id."""
    return docs.select(F.col(key).alias("file_id"), F.col(key).cast("string").alias("path"), F.col(text).alias("text"))
