"""Line dedup by a suffix array over line-id sequences (operator 2, DataFrame functions only).

A document is the sequence of ids of its lines that hold a word; a suffix is a document and a
line. The suffix array is built by distributed prefix doubling: ranks of suffixes by their first
2^k lines, found from pairs of ranks by their first 2^(k-1) lines. In each round the distinct
pairs are put in order by range partitions, and a pair's rank is its place, counted on
from the partitions before it. Suffixes with one rank are an LCP interval at depth
2^k, and any depth m between 2^k and 2^(k+1) is known from two overlapping ranks of level k.

A line goes if it lies in a run of at least ``min_words`` words that occurs before (at a
smaller (key, text hash, line), also within one document). For each suffix the depth is
looked up that just holds ``min_words`` words, and the same for each line from its
end; a maximal repeated run is the union of these. All but the first suffix of each interval
at that depth are later copies, and their lines are deleted.

Two facts keep the rounds small, and both are exact: a repeated run holds only lines that occur
twice or more, so all other lines leave before the first round, and so do stretches of
repeated lines of fewer than ``min_words`` words; a suffix whose rank is its own, or that
holds ``min_words`` words already, needs no deeper rank. Rounds end when none is left.

A line's id is the place of the first 128 bits of its SHA-256 among those of all repeated lines, so
equal ids mean equal lines. Blank lines belong to no run and stay. Null texts count as
empty. Rows that repeat both key and text are one document: they get the same result
and are no copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, ranked, table


def _line_ids(rows: DataFrame) -> DataFrame:
    """(d, i, w, r) of the repeated lines: document, place among its lines with words, words and rank."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    ids = F.transform(lines, lambda x: F.struct(F.unhex(F.substring(F.sha2(x, 256), 1, 32)).alias("id"), F.regexp_count(x, F.lit(WORD + "+")).cast("long").alias("w")))
    every = checkpointed(rows.select("d", F.posexplode(ids).alias("i", "l")).select("d", "i", "l.id", "l.w"))
    again = every.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    # written before the join, so that Spark can split a line that very many texts have
    return every.join(checkpointed(ranked(again, "id")), "id").select("d", "i", "w", F.col("rank").alias("r"))


def _suffixes(rows: DataFrame, min_words: int) -> DataFrame:
    """(d, i, r, ahead, back, need) of suffixes in stretches of ``min_words`` words of repeated lines.

    ``ahead`` and ``back`` are the least numbers of lines with that many words from line i
    on and up to it (null: there are none); ``need`` is the highest level to be ranked.
    """
    document = Window.partitionBy("d")
    lines = _line_ids(rows).repartition("d").dropDuplicates(["d", "i"])
    lines = lines.withColumn("stretch", F.col("i") - F.row_number().over(document.orderBy("i")))
    lines = lines.withColumn("all", F.sum("w").over(Window.partitionBy("d", "stretch"))).filter(F.col("all") >= min_words)
    # words up to and with a line (c), and up to it (b); a gap between stretches is seen in i
    lines = lines.withColumn("c", F.sum("w").over(document.orderBy("i"))).withColumn("b", F.col("c") - F.col("w"))
    on, off = document.orderBy("b").rangeBetween(0, min_words - 1), document.orderBy("c").rangeBetween(1 - min_words, 0)
    ahead = F.when((F.max("c").over(on) >= F.col("b") + min_words) & (F.max("i").over(on) == F.col("i") + F.count("*").over(on) - 1), F.count("*").over(on))
    back = F.when((F.min("b").over(off) <= F.col("c") - min_words) & (F.min("i").over(off) == F.col("i") - F.count("*").over(off) + 1), F.count("*").over(off))
    lines = lines.withColumn("ahead", ahead).withColumn("back", back)
    need = F.lit(0)
    for k in range(1, min_words.bit_length()):
        last = F.first(F.struct("c", "w")).over(document.orderBy("i").rangeBetween((1 << k) - 1, (1 << k) - 1))
        inner = last["c"] - F.col("b") - F.greatest(F.col("w"), last["w"])
        need = F.when(inner < min_words, k).otherwise(need)
    return lines.select("d", "i", "r", "ahead", "back", need.alias("need"))


def _rank_tables(suffixes: DataFrame) -> DataFrame:
    """(k, d, i, r): the ranks by 2^k lines of all suffixes that share them and are needed."""
    now = suffixes.select("d", "i", "need", "r")
    out, k = now.select(F.lit(0).alias("k"), "d", "i", "r"), 0
    while True:
        half = Window.partitionBy("d").orderBy("i").rangeBetween(1 << k, 1 << k)
        pairs = checkpointed(now.withColumn("after", F.first("r").over(half)).filter((F.col("need") > k) & F.col("after").isNotNull()))
        if pairs.isEmpty():
            return out
        shared = pairs.groupBy("r", "after").agg(F.count("*").alias("n")).filter("n > 1").select("r", "after")
        now = checkpointed(pairs.join(checkpointed(ranked(shared, "r", "after")), ["r", "after"]).select("d", "i", "need", F.col("rank").alias("r")))
        k += 1
        out = out.union(now.select(F.lit(k), "d", "i", "r"))


def _intervals(suffixes: DataFrame, ranks: DataFrame) -> DataFrame:
    """(d, s, m, x, y): runs of m lines from line s; those with equal (m, x, y) are one LCP interval."""
    runs = F.array_distinct(F.filter(F.array(F.struct(F.col("i").alias("s"), F.col("ahead").alias("m")), F.struct((F.col("i") + 1 - F.col("back")).alias("s"), F.col("back").alias("m"))), lambda x: x["m"].isNotNull()))
    rows = suffixes.select("d", F.explode(runs).alias("run")).select("d", F.col("run.s").cast("int").alias("s"), F.col("run.m").cast("int").alias("m")).distinct()
    rows = rows.withColumn("k", F.floor(F.log2("m")).cast("int")).withColumn("e", F.expr("s + m - shiftleft(1, k)"))
    one, other = ranks.select("k", "d", F.col("i").alias("s"), F.col("r").alias("x")), ranks.select("k", "d", F.col("i").alias("e"), F.col("r").alias("y"))
    return rows.join(one, ["k", "d", "s"]).join(other, ["k", "d", "e"]).select("d", "s", "m", "x", "y")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """(d, gone): document (key, text hash) and the indices, among its lines with words, of later copies."""
    rows = docs.select(F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("h")).alias("d"), F.col(text).alias("text"))
    suffixes = checkpointed(_suffixes(rows, min_words))
    runs = checkpointed(_intervals(suffixes, _rank_tables(suffixes)))
    interval = ["m", "x", "y"]
    first = runs.groupBy(*interval).agg(F.min(F.struct("d", "s")).alias("first"), F.max(F.struct("d", "s")).alias("last")).filter("first < last").select(*interval, "first")
    later = runs.join(checkpointed(first), interval).filter(F.struct("d", "s") > F.col("first"))
    return later.select("d", F.explode(F.expr("sequence(s, s + m - 1)")).alias("i")).groupBy("d").agg(F.collect_set("i").alias("gone"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` without later copies, and with ``n_lines`` and ``n_removed`` (lines with a word).

    A document of which no word is left has an empty text; a null text stays null. Columns
    of ``docs`` called ``n_lines`` or ``n_removed`` are replaced.
    """
    gone = repeated_lines(docs, key, text, min_words).select(F.col("d.key").alias("__key"), F.col("d.h").alias("__h"), F.col("gone").alias("__gone"))
    out = docs.drop("n_lines", "n_removed").join(gone, F.col("__key").eqNullSafe(F.col(key)) & (F.col("__h") == F.xxhash64(text)), "left")
    out = out.withColumn("__l", F.split(F.coalesce(text, F.lit("")), "\n", -1))
    out = out.withColumn("__n", F.filter(F.transform("__l", lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull()))
    keep = F.expr("array_except(sequence(0, size(__l) - 1), transform(__gone, i -> __n[i]))")
    left = F.array_join(F.transform(keep, lambda i: F.col("__l")[i]), "\n")
    new = F.when(F.col("__gone").isNull(), F.col(text)).when(F.size("__gone") == F.size("__n"), F.lit("")).otherwise(left)
    removed = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone"))
    extra = [F.size("__n").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed")]
    return out.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")], *extra)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text after line dedup, with its counts of lines before and removed."""
    return drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated runs go, and documents of which nothing is left by that."""
    out = drop_repeated_lines(docs).filter("n_removed = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


ORACLE = r"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS o FROM documents),
ln AS (SELECT doc_id, line, o, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS p, sum(w) OVER (PARTITION BY doc_id ORDER BY o) AS c FROM ln),
rg AS (SELECT a.doc_id, a.p AS s, b.p AS e FROM nb a JOIN nb b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.p < a.p + 60
       WHERE b.c - a.c + a.w >= 50 AND (b.c - a.c + a.w - b.w < 50 OR b.c - a.c < 50)),
rt AS (SELECT rg.doc_id, s, e, string_agg(line, chr(10) ORDER BY p) AS t FROM rg JOIN nb ON nb.doc_id = rg.doc_id AND nb.p BETWEEN s AND e GROUP BY ALL),
ft AS (SELECT *, min((doc_id, s)) OVER (PARTITION BY t) AS f FROM rt),
gone AS (SELECT DISTINCT nb.doc_id, nb.o FROM ft JOIN nb ON nb.doc_id = ft.doc_id AND nb.p BETWEEN s AND e WHERE (ft.doc_id, ft.s) > f),
lines AS (SELECT raw.doc_id, raw.o, raw.line, ln.o IS NOT NULL AS word, gone.o IS NOT NULL AS cut FROM raw LEFT JOIN ln ON ln.doc_id = raw.doc_id AND ln.o = raw.o LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.o = raw.o)
SELECT doc_id, count(*) FILTER (WHERE word) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed,
       CASE WHEN count(*) FILTER (WHERE word AND NOT cut) = 0 AND count(*) FILTER (WHERE cut) > 0 THEN '' ELSE string_agg(line, chr(10) ORDER BY o) FILTER (WHERE NOT cut) END AS text
FROM lines GROUP BY doc_id
"""
