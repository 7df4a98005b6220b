"""The registered queries over the driver's tables, and their DuckDB twins."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec
from .functions.text import spans
from .operators import postings as P
from .operators import search as S
from .operators import update as U
from .operators.batch import batch_table
from .plans.pattern import plan, trigrams_of
from .shared import Store, checkpointed, shared_dir
from .sources import corpus as C
from .sources.store import Index, Pieces, root_key, search_index, summary
from .streaming import ingest

NEW = """
select concat('src', cast(doc_id % 50 as string), '/', lang, '/', cast(doc_id as string), case when doc_id % 20 = 0 then '.pdf' else '.txt' end) as path,
       case when doc_id % 31 = 0 then 0 else 1700000000000000000 + doc_id * 1000 end as mtime_ns,
       case when doc_id % 17 = 0 then concat(repeat(chr(1), 600), text)
            when doc_id % 29 = 0 then concat(replace(text, chr(10), concat(chr(13), chr(10))), chr(13), chr(10))
            when doc_id % 2  = 0 then concat(text, chr(10))
            else text end as content, doc_id
from {documents}"""
OLD = """
select concat('src', cast(doc_id % 50 as string), '/', lang, '/', cast(doc_id as string), '.txt') as path,
       case when doc_id % 31 = 0 then 0
            when doc_id % 11 = 0 or doc_id % 13 = 0 then 1600000000000000000
            else 1700000000000000000 + doc_id * 1000 end as mtime_ns,
       case when doc_id % 11 = 0 then concat(text, ' old tail')
            when doc_id % 29 = 0 then concat(replace(text, chr(10), concat(chr(13), chr(10))), chr(13), chr(10))
            when doc_id % 2  = 0 then concat(text, chr(10))
            else text end as content
from {documents} where doc_id % 7 <> 0 and doc_id % 20 <> 0
union all
select concat('gone/', cast(item_id as string), '.txt'), 1500000000000000000, text from {benchmark}"""

PATTERNS = {1: "license", 2: "tion.*heit", 3: "thand", 4: "[0-9]{3}-[0-9]{4}"}
TRIGRAM_PAIRS = [("the", "and"), ("ion", "ent"), ("sch", "und"), ("que", "men")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.content_of(spark, _table(spark, sf_dir, "documents"))


def _snapshot(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """path, mtime_ns, size and content (bytes) of a snapshot derived from the documents."""
    frame = spark.sql(sql, documents=_table(spark, sf_dir, "documents"), benchmark=_table(spark, sf_dir, "benchmark")) if "benchmark" in sql else spark.sql(sql, documents=_table(spark, sf_dir, "documents"))
    return frame.withColumn("content", F.encode("content", "UTF-8")).withColumn("size", F.octet_length("content").cast("long"))


def _cleared(frame: DataFrame, *folders: str, paths: DataFrame | None = None) -> DataFrame:
    """The frame, written to the shared folder, without the scratch folders that it was made from.

    With ``paths`` tasks delete these files below the first folder, which are too many for the driver.
    """
    out = checkpointed(frame)
    if paths is not None:
        C.delete_files(paths, folders[0])
    for folder in folders:
        Store(frame.sparkSession, folder).delete()
    return out


_built: dict[tuple[str, str], Index] = {}


def documents_index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of a directory's documents, built once a session; file ids are doc ids."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        name = hashlib.sha1(f"{key}".encode()).hexdigest()[:16]
        index = Index(spark, f"{shared_dir(spark)}/text-index-{name}", sf_dir)
        index.build(C.from_table(_table(spark, sf_dir, "documents")).withColumn("doc_id", F.col("path").cast("long")), ids="doc_id")
        _built[key] = index
    return _built[key]


def _hits(spark: SparkSession, sf_dir: str, pattern: str, ignore_case: bool = False) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return S.search(_content(spark, sf_dir), pattern, ignore_case, index.postings(), index.stats(), index.files())


def _search(pattern: str, ignore_case: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _hits(spark, sf_dir, pattern, ignore_case).select(F.col("file_id").alias("doc_id"), "lineno", "line")

    return run


def corpus_indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.indexable(_snapshot(spark, sf_dir, NEW)).select("path", "size", "reason")


#: Names of the derived tree: some start with a dot or underscore, and some are no part of it.
TREE = """
select concat(case doc_id % 7 when 0 then '.git/' when 1 then '.github/' when 2 then '_site/' else '' end, lang, '/',
              case doc_id % 5 when 0 then '.env' when 1 then '__init__' when 2 then '_config' else 'file' end, '-', cast(doc_id as string), '.txt') as path, {fields}
from documents"""


def _written_tree(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Every document as a file of its own in the shared folder; the tree's root, and the files' paths."""
    root = f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/tree-{uuid.uuid4().hex}"
    rows = spark.sql(TREE.format(fields="text").replace("from documents", "from {documents}"), documents=_table(spark, sf_dir, "documents"))
    C.write_tree(rows.select("path", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), root)
    return root, rows.select("path")


def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files listed and read again: hidden names are in, .git folders are not."""
    root, paths = _written_tree(spark, sf_dir)
    return _cleared(C.Tree(spark, root).whole().select("path", "size", F.md5("content").alias("digest")), root, paths=paths)


def tree_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of half of a tree is indexed, then the whole tree; counts of both updates."""
    root, paths = _written_tree(spark, sf_dir)
    every = C.Tree(spark, root).listing().select("path")
    index = Index(spark, f"{shared_dir(spark)}/tree-index-{uuid.uuid4().hex}", root)
    steps = [index.update(C.Tree(spark, root, some)) for some in (every.filter("path like '%__init__%' or path like '%.env%'"), every)]
    names = ("added", "changed", "removed", "unchanged")
    counts = spark.createDataFrame([(k, *(s[n] for n in names)) for k, s in enumerate(steps, 1)], "step int, " + ", ".join(f"{n} long" for n in names))
    return _cleared(counts, root, index.store.base, paths=paths)


def _snapshot_tree(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The new snapshot as files, some of them with names or content that is no text; the tree's root, and the files' paths."""
    root = f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/tree-{uuid.uuid4().hex}"
    rows = _snapshot(spark, sf_dir, NEW)
    C.write_tree(rows, root)
    return root, rows.select("path")


def tree_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index of a tree knows to be no text, after an update that opened no file again."""
    root, paths = _snapshot_tree(spark, sf_dir)
    tree, index = C.Tree(spark, root), Index(spark, f"{shared_dir(spark)}/tree-index-{uuid.uuid4().hex}", root)
    index.update(tree)
    before = tree.opened.value
    index.update(tree)
    return _cleared(index.rejected().select("path", "size", "reason", F.lit(tree.opened.value - before).cast("long").alias("opened_again")), root, index.store.base, paths=paths)


def tree_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a manifest lists that is no file, and how an update counts it."""
    root, paths = _snapshot_tree(spark, sf_dir)
    manifest = _snapshot(spark, sf_dir, NEW).select("path").union(_snapshot(spark, sf_dir, OLD).select("path"))
    tree = C.Tree(spark, root, manifest)
    index = Index(spark, f"{shared_dir(spark)}/tree-index-{uuid.uuid4().hex}", root)
    stats = index.update(tree)
    return _cleared(tree.unreadable().withColumn("counted", F.lit(stats["skipped_unreadable"]).cast("long")), root, index.store.base, paths=paths)


class _Stopped(Exception):
    pass


def resumed_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree's build in four pieces that is stopped after two, and goes on: the files that readers see, and their ids."""
    root, paths = _snapshot_tree(spark, sf_dir)
    tree, base = C.Tree(spark, root), f"{shared_dir(spark)}/tree-index-{uuid.uuid4().hex}"
    share = -(-tree.listing().count() // 4)
    index, taken, take = Index(spark, base, root), [], Index._taken_in

    def stopping(*args):
        if len(taken) == 2:
            raise _Stopped
        taken.append(args)
        return take(index, *args)

    index._taken_in = stopping
    try:
        index.build(tree, pieces=Pieces(files=share))
    except _Stopped:
        pass
    seen = Index(spark, base, root).manifest()
    index = Index(spark, base, root)
    index.build(tree)
    return _cleared(index.files().select("path", "file_id", F.lit(seen is not None).alias("seen_early")), root, base, paths=paths)


def appended_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents appended in nine parts, eight of which merge; lists and generations after that."""
    index = Index(spark, f"{shared_dir(spark)}/text-parts-{uuid.uuid4().hex}", sf_dir)
    docs = _table(spark, sf_dir, "documents")
    for k in range(9):
        index.append(C.from_table(docs.filter(f"doc_id % 9 = {k}")), k)
    return _cleared(index.stats().withColumn("generations", F.lit(len(index.manifest()["generations"])).cast("long")), index.store.base)


def index_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct trigrams by the stored sketches against an exact count, and the number of lists."""
    index = documents_index(spark, sf_dir)
    exact = index.stats().agg(F.count("*").alias("exact"))
    both = index.approximate().crossJoin(exact)  # one row and one row
    return both.select("lists", (F.abs(F.col("distinct_trigrams") - F.col("exact")) * 50 <= F.col("exact")).alias("close"))


def forward_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New pairs of an update by trigram, from the stored trigrams of the changed files."""
    index = Index(spark, f"{shared_dir(spark)}/text-forward-{uuid.uuid4().hex}", sf_dir, forward=True)
    index.update(_snapshot(spark, sf_dir, OLD))
    index.update(_snapshot(spark, sf_dir, NEW))
    added = spark.read.parquet(index.store.at(index.manifest()["generations"][-1]["name"], "stats"))
    return _cleared(added.select("trigram", F.col("df").alias("n_new")), index.store.base)


def root_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that the indexes of many roots would have."""
    return _snapshot(spark, sf_dir, NEW).select("path", root_key(F.col("path")).alias("key"))


def manifest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, manifest = _snapshot(spark, sf_dir, NEW), _snapshot(spark, sf_dir, OLD)
    there = C.listed(C.distinct_listing(corpus.select("path")), manifest).select("path", F.lit(True).alias("present"))
    return there.unionByName(C.missing(corpus, manifest).select("path", F.lit(False).alias("present")))


def doc_trigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(codec.trigrams("text")).cast("long").alias("n_trigrams"))


def trigram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.encode("text", "UTF-8").alias("content"))
    return P.document_frequency(P.inverted(files))


def posting_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents_index(spark, sf_dir).postings()
    return rows.select("trigram", "block", F.size("ids").cast("long").alias("n_ids"), F.array_min("ids").alias("min_id"), F.array_max("ids").alias("max_id"), codec.encoded_size(F.col("ids")).alias("gap_bytes"))


def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return summary(index.files(), index.postings())


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full build from scratch, and what it holds."""
    index = Index(spark, f"{shared_dir(spark)}/text-build-{uuid.uuid4().hex}", sf_dir)
    index.build(C.from_table(_table(spark, sf_dir, "documents")))
    return _cleared(summary(index.files(), index.postings()).select("files", "distinct_trigrams", "pairs"), index.store.base)


def search_crlf(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = _snapshot(spark, sf_dir, NEW).select(F.col("doc_id").alias("file_id"), "path", F.decode("content", "UTF-8").alias("text"))
    return S.search(content, r"en\.$").select(F.col("file_id").alias("doc_id"), "lineno", "line")


def candidate_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.selectivity(_content(spark, sf_dir), [PATTERNS[1], PATTERNS[2], PATTERNS[3]], documents_index(spark, sf_dir).postings())


def rarest_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three rarest of a pattern's trigrams, and how many files hold each."""
    required = plan("thand.*tion").required
    return documents_index(spark, sf_dir).stats().filter(F.col("trigram").isin(list(required))).orderBy("df", "trigram").limit(3)


def hits_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hits_per_file(_hits(spark, sf_dir, "license")).select(F.col("file_id").alias("doc_id"), "n_lines")


def hit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hit_totals(_hits(spark, sf_dir, "thand"))


def hits_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.grouped_text(_hits(spark, sf_dir, "license")).select(F.col("file_id").alias("doc_id"), "value")


def first_hit_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_per_file(_hits(spark, sf_dir, "thand")).select(F.col("file_id").alias("doc_id"), "lineno", "line")


def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten hits, by growing ranges of candidates."""
    index, content = documents_index(spark, sf_dir), _content(spark, sf_dir)
    query = plan("thand", spark=spark)
    live = checkpointed(index.files().select("file_id").join(S.narrowed(query, index.postings(), index.stats()), "file_id", "left_semi"))
    found = S.first_hits_of(live, lambda rows: content.join(rows, "file_id", "left_semi"), query, 10)
    return found.select(F.col("file_id").alias("doc_id"), "lineno", "line")


def hits_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits with their places in the order in which they are shown."""
    hits = _hits(spark, sf_dir, "license").withColumn("at", F.struct("file_id", "lineno"))
    placed = hits.select("at", "line").toDF("path", "line")
    return U.with_ids(placed, 0).select(F.col("path.file_id").alias("doc_id"), F.col("path.lineno").alias("lineno"), F.col("file_id").alias("place"))


def hits_flat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.flat_text(_hits(spark, sf_dir, "license"))


def hits_highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.highlighted_hits(_hits(spark, sf_dir, "thand"), "thand").select(F.col("file_id").alias("doc_id"), "lineno", "shown")


def match_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    java = plan("an[dt]h?").java
    hits = _hits(spark, sf_dir, "an[dt]h?")
    rows = hits.select(F.col("file_id").alias("doc_id"), "lineno", F.posexplode(spans(F.col("line"), java)).alias("k", "s"))
    return rows.select("doc_id", "lineno", "k", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("text"))


def batch_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    out = S.batch(_content(spark, sf_dir), PATTERNS, index.postings(), index.stats(), index.files())
    return out.select("pattern_id", F.col("file_id").alias("doc_id"), "n_lines")


#: A pattern for each benchmark item: two of its words, not far from each other.
ITEM_PATTERN = "concat(regexp_replace(split_part(text, ' ', 2), '[^A-Za-z]', '.'{g}), '.*', regexp_replace(split_part(text, ' ', 3), '[^A-Za-z]', '.'{g}))"


def pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that a table of patterns finds, one pattern for each benchmark item."""
    index = documents_index(spark, sf_dir)
    patterns = _table(spark, sf_dir, "benchmark").select("item_id", F.expr(ITEM_PATTERN.format(g="")).alias("pattern"))
    out = batch_table(_content(spark, sf_dir), patterns, index.postings(), index.stats(), index.files(), id="item_id")
    return out.withColumnRenamed("file_id", "doc_id")


def _stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files table that the old snapshot's index holds."""
    old = U.indexable(_snapshot(spark, sf_dir, OLD)).filter("reason = 'ok'")
    return U.with_ids(old.select("path", "mtime_ns", "size", F.xxhash64("content").alias("content_hash")), 0)


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.diff(_snapshot(spark, sf_dir, NEW), _stored_files(spark, sf_dir))


def diff_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).filter("status <> 'ignored'").select("path", "status", "by")


def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.counts(_changes(spark, sf_dir))


def assigned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_files(spark, sf_dir).select("path", "file_id")


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Old postings in blocks, the new snapshot with the ids that an update gives, live files, and bytes of the old snapshot."""
    files = checkpointed(_stored_files(spark, sf_dir))
    changes = checkpointed(U.diff(_snapshot(spark, sf_dir, NEW), files))
    last, size = files.agg(F.max("file_id"), F.coalesce(F.sum("size"), F.lit(0))).first()
    added = U.with_ids(changes.filter("status = 'added'").drop("file_id"), last)
    live = changes.filter("status in ('unchanged', 'changed')").select("path", "file_id", "status").unionByName(added.select("path", "file_id", "status"))
    old = P.inverted(_snapshot(spark, sf_dir, OLD).join(files.select("path", "file_id"), "path"), size)
    return old, _snapshot(spark, sf_dir, NEW).join(live, "path"), live, size


def _new_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, live, size = _old_and_new(spark, sf_dir)
    return P.lacking(P.short_lists(new.filter("status in ('added', 'changed')")), old, live.filter("status = 'changed'"), size)


def postings_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new_lists(spark, sf_dir).groupBy("trigram").agg(F.sum(F.size("ids")).alias("n_new"))


def lists_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.lists_rewritten(_new_lists(spark, sf_dir))


def stale_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, live, size = _old_and_new(spark, sf_dir)
    return P.stale(old, P.short_lists(new), live, size)


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, block, one, other): lists of both trigrams of each pair, block by block."""
    names = [(a, b, trigrams_of(a.encode()).pop(), trigrams_of(b.encode()).pop()) for a, b in TRIGRAM_PAIRS]
    pairs = spark.createDataFrame(names, "a string, b string, x int, y int")
    lists = documents_index(spark, sf_dir).postings().filter(F.col("trigram").isin([t for n in names for t in n[2:]])).select("trigram", "block", "ids")
    one = lists.toDF("x", "block", "one").join(pairs, "x")
    other = lists.toDF("y", "block", "other").join(pairs, "y").select("a", "b", "block", "other")
    both = one.select("a", "b", "block", "one").join(other, ["a", "b", "block"], "full_outer")
    none = F.array().cast("array<bigint>")
    return both.select("a", "b", F.coalesce("one", none).alias("one"), F.coalesce("other", none).alias("other"))


def postings_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = codec.intersected(F.col("one"), F.col("other"))
    return _lists(spark, sf_dir).groupBy("a", "b").agg(F.sum(F.size(both)).cast("long").alias("n"))


def postings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).groupBy("a", "b").agg(F.sum(F.size(codec.merged(F.col("one"), F.col("other")))).cast("long").alias("n"), F.max(codec.merge_changes(F.col("one"), F.col("other"))).alias("changed"))


def posting_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest gap and the number of ids of each trigram's list."""
    rows = documents_index(spark, sf_dir).postings().select("trigram", F.explode("ids").alias("file_id"))
    return P.id_gaps(rows).groupBy("trigram").agg(F.max("gap").alias("widest"), F.count("*").alias("n"))


def path_fnv1a64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir, NEW).select("path", codec.fnv1a64("path").alias("hash"))


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents_index(spark, sf_dir).postings().select("trigram", F.col("ids").alias("before"), codec.encode_postings("ids").alias("encoded"))
    done = P.validated(rows)
    return done.select("trigram", F.size("before").cast("long").alias("n"), (F.col("ids") == F.col("before")).alias("ok"), "error", F.octet_length("encoded").cast("long").alias("bytes"))


def _updated_index(spark: SparkSession, sf_dir: str) -> tuple[Index, DataFrame]:
    """An index of the old snapshot, and the new snapshot."""
    index = Index(spark, f"{shared_dir(spark)}/text-update-{uuid.uuid4().hex}", sf_dir)
    index.update(_snapshot(spark, sf_dir, OLD))
    return index, _snapshot(spark, sf_dir, NEW)


def search_after_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in the new snapshot through the old index as it is (step 1), and brought up to date (step 2)."""
    index, new = _updated_index(spark, sf_dir)
    stale = checkpointed(search_index(index, new, "license"))
    fresh = search_index(index, new, "license", update=True)
    both = stale.select(F.lit(1).alias("step"), "path", "lineno", "line").unionByName(fresh.select(F.lit(2).alias("step"), "path", "lineno", "line"))
    return _cleared(both, index.store.base)


def compacted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index holds after an update and after compacting it."""
    index, new = _updated_index(spark, sf_dir)
    index.update(new)
    updated = checkpointed(summary(index.files(), index.postings()).select(F.lit("updated").alias("state"), "files", "pairs"))
    index.compact(new)
    return _cleared(updated.unionByName(summary(index.files(), index.postings()).select(F.lit("compacted").alias("state"), "files", "pairs")), index.store.base)


def live_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an updated index that hold all trigrams of a pattern, without those that are gone."""
    index, new = _updated_index(spark, sf_dir)
    index.update(new)
    return _cleared(index.files().join(S.narrowed(plan("tion"), index.postings(), index.stats()), "file_id", "left_semi").select("path"), index.store.base)


def posting_list_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.posting_list(documents_index(spark, sf_dir).postings(), trigrams_of(b"lic").pop()).select(F.col("file_id").alias("doc_id"))


def file_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored row of one file, and no row for an id that was never given."""
    index = documents_index(spark, sf_dir)
    return index.file(7).unionByName(index.file(-1)).select("file_id", "path", "size")


def packed_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three bytes of every document as a trigram."""
    head = F.substring(F.encode("text", "UTF-8"), 1, 3)
    return _table(spark, sf_dir, "documents").filter(F.octet_length("text") >= 3).select("doc_id", codec.pack(head).alias("trigram"))


def shown_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as they are shown, below a base and without one."""
    rows = _snapshot(spark, sf_dir, NEW)
    return rows.select("path", C.shown_path(F.col("path"), "corpus/").alias("below"), C.shown_path(F.col("path")).alias("plain"))


def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    index = Index(spark, f"{base}/index", sf_dir)
    ingest.index_stream(ingest.table_stream(spark, f"{sf_dir}/documents.parquet", 4), index, f"{base}/checkpoint").awaitTermination()
    return _cleared(index.stats(), base)


def stream_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    hits = ingest.standing_search(ingest.table_stream(spark, f"{sf_dir}/documents.parquet", 4), "license")
    ingest.hits_stream(hits, f"{base}/hits", f"{base}/checkpoint").awaitTermination()
    return _cleared(spark.read.schema(hits.schema).parquet(f"{base}/hits"), base)


QUERIES = {
    "corpus_indexable": corpus_indexable,
    "manifest_listing": manifest_listing,
    "tree_listing": tree_listing,
    "tree_update": tree_update,
    "tree_rejections": tree_rejections,
    "tree_skips": tree_skips,
    "resumed_build": resumed_build,
    "appended_levels": appended_levels,
    "index_sketch": index_sketch,
    "forward_delta": forward_delta,
    "root_keys": root_keys,
    "pattern_table": pattern_table,
    "hits_in_order": hits_in_order,
    "doc_trigram_counts": doc_trigram_counts,
    "trigram_df": trigram_df,
    "posting_blocks": posting_blocks,
    "index_build": index_build,
    "index_summary": index_summary,
    "search_literal": _search("license"),
    "search_regex": _search("tion.*heit"),
    "search_ignore_case": _search("THAND", True),
    "search_scan_fallback": _search("[0-9]{3}-[0-9]{4}"),
    "search_crlf": search_crlf,
    "candidate_selectivity": candidate_selectivity,
    "rarest_trigrams": rarest_trigrams,
    "hits_per_file": hits_per_file,
    "hit_totals": hit_totals,
    "hits_grouped": hits_grouped,
    "first_hit_per_file": first_hit_per_file,
    "first_hits": first_hits,
    "hits_flat_text": hits_flat_text,
    "hits_highlighted": hits_highlighted,
    "match_spans": match_spans,
    "batch_patterns": batch_patterns,
    "diff_status": diff_status,
    "diff_stats": diff_stats,
    "assigned_ids": assigned_ids,
    "postings_delta": postings_delta,
    "lists_rewritten": lists_rewritten,
    "stale_postings": stale_postings,
    "postings_intersect": postings_intersect,
    "postings_merge": postings_merge,
    "posting_gaps": posting_gaps,
    "path_fnv1a64": path_fnv1a64,
    "codec_roundtrip": codec_roundtrip,
    "search_after_update": search_after_update,
    "compacted_index": compacted_index,
    "live_candidates": live_candidates,
    "posting_list_ids": posting_list_ids,
    "file_by_id": file_by_id,
    "packed_heads": packed_heads,
    "shown_paths": shown_paths,
    "stream_index": stream_index,
    "stream_search": stream_search,
}

_NEW = f"snew AS ({NEW.format(documents='documents').replace('as string', 'as varchar')})"
_TREE = TREE.replace("as string", "as varchar")
_OLD = f"sold AS ({OLD.format(documents='documents', benchmark='benchmark').replace('as string', 'as varchar')})"


def _grams(source: str, key: str, content: str, name: str = "g") -> str:
    """Distinct (key, trigram as six hex digits) of a table."""
    parts = " UNION ".join(f"SELECT {key}, unnest(regexp_extract_all(substr(h, {k}), '.{{6}}')) AS t FROM {name}h" for k in (1, 3, 5))
    return f"{name}h AS MATERIALIZED (SELECT {key}, hex(encode({content})) AS h FROM {source}), {name} AS ({parts})"


def _lines(source: str, key: str, text: str, where: str = "true") -> str:
    return f"""b AS (SELECT {key}, CASE WHEN ends_with({text}, chr(10)) THEN left({text}, length({text}) - 1) ELSE {text} END AS body FROM {source} WHERE {where}),
l AS (SELECT {key}, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1)::INT AS lineno FROM b WHERE body <> '')"""


def _hit_sql(pattern: str, tail: str, options: str = "c") -> str:
    return f"WITH {_lines('documents', 'doc_id', 'text')}, hit AS (SELECT doc_id, lineno, regexp_replace(raw, '\\r$', '') AS line FROM l WHERE regexp_matches(raw, '{pattern}', '{options}')) {tail}"


_ALL = "SELECT doc_id, lineno, line FROM hit"
_NUMBER = "('0x' || t)::INTEGER"
_CONTROL = r"len(regexp_extract_all(substr(content, 1, 8192), '[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]')) * 20 > least(8192, strlen(content))"
_REASON = f"CASE WHEN strlen(content) > 67108864 THEN 'too_large' WHEN ends_with(path, '.pdf') THEN 'binary_name' WHEN contains(content, chr(0)) THEN 'nul' WHEN {_CONTROL} THEN 'control' ELSE 'ok' END"
_STORED = f"stored AS (SELECT * FROM (SELECT *, {_REASON} AS reason FROM sold) WHERE reason = 'ok')"
_DIFF = f"""d AS (SELECT coalesce(n.path, o.path) AS path, n.content AS new_content, o.content AS old_content,
    CASE WHEN n.path IS NULL THEN 'removed' WHEN o.path IS NOT NULL AND n.mtime_ns <> 0 AND n.mtime_ns = o.mtime_ns AND strlen(n.content) = strlen(o.content) THEN 'unchanged'
         WHEN n.reason <> 'ok' AND o.path IS NOT NULL THEN 'removed' WHEN n.reason <> 'ok' THEN 'ignored' WHEN o.path IS NULL THEN 'added'
         WHEN n.content = o.content THEN 'unchanged' ELSE 'changed' END AS status,
    CASE WHEN n.path IS NULL THEN 'listing' WHEN o.path IS NOT NULL AND n.mtime_ns <> 0 AND n.mtime_ns = o.mtime_ns AND strlen(n.content) = strlen(o.content) THEN 'stat' ELSE 'content' END AS "by"
    FROM (SELECT *, {_REASON} AS reason FROM snew) n FULL JOIN stored o ON n.path = o.path)"""
_DELTA = f"""WITH {_NEW}, {_OLD}, {_STORED}, {_DIFF}, nd AS (SELECT path, new_content FROM d WHERE status IN ('added', 'changed')),
{_grams("nd", "path", "new_content", "gn")}, od AS (SELECT path, old_content FROM d WHERE status = 'changed'), {_grams("od", "path", "old_content", "go")},
x AS (SELECT * FROM gn EXCEPT SELECT * FROM go)"""
_BITS = "ceil(length(bin(gap)) / 7.0)"


def _selectivity_sql(pattern: str, grams: list[str]) -> str:
    every = " AND ".join(f"contains(text, '{g}')" for g in grams)
    return f"SELECT '{pattern}' AS pattern, {len(grams)} AS required, count(*) FILTER (WHERE {every}) AS candidates, count(*) FILTER (WHERE len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{pattern}'))) > 0) AS matched FROM documents"


def _pairs_sql(join: str, extra: str) -> str:
    values = ", ".join(f"('{a}', '{b}')" for a, b in TRIGRAM_PAIRS)
    return f"WITH p(a, b) AS (VALUES {values}) SELECT a, b, count(*) FILTER (WHERE contains(text, a) {join} contains(text, b)) AS n{extra} FROM p, documents GROUP BY a, b"


ORACLES = {
    "corpus_indexable": f"WITH {_NEW} SELECT path, strlen(content) AS size, {_REASON} AS reason FROM snew",
    "manifest_listing": f"WITH {_NEW}, {_OLD} SELECT DISTINCT path, path IN (SELECT path FROM snew) AS present FROM sold",
    "tree_listing": f"SELECT path, size, digest FROM ({_TREE.format(fields="strlen(coalesce(text, '')) AS size, md5(coalesce(text, '')) AS digest")}) WHERE NOT starts_with(path, '.git/')",
    "tree_update": f"""WITH t AS ({_TREE.format(fields="doc_id")}), n AS (SELECT contains(path, '__init__') OR contains(path, '.env') AS early FROM t WHERE NOT starts_with(path, '.git/'))
        SELECT 1 AS step, count(*) FILTER (WHERE early) AS added, 0::BIGINT AS changed, 0::BIGINT AS removed, 0::BIGINT AS unchanged FROM n
        UNION ALL SELECT 2, count(*) FILTER (WHERE NOT early), 0, 0, count(*) FILTER (WHERE early) FROM n""",
    "doc_trigram_counts": f"WITH {_grams('documents', 'doc_id', 'text')} SELECT documents.doc_id, count(t) AS n_trigrams FROM documents LEFT JOIN g ON g.doc_id = documents.doc_id GROUP BY documents.doc_id",
    "trigram_df": f"WITH {_grams('documents', 'doc_id', 'text')} SELECT {_NUMBER} AS trigram, count(*) AS df FROM g GROUP BY t",
    "posting_blocks": f"""WITH {_grams("documents", "doc_id", "text")}, k AS (SELECT t, doc_id, doc_id // 65536 AS block, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY t, doc_id // 65536 ORDER BY doc_id) AS gap FROM g)
        SELECT {_NUMBER} AS trigram, block, count(*) AS n_ids, min(doc_id) AS min_id, max(doc_id) AS max_id, sum({_BITS})::BIGINT AS gap_bytes FROM k GROUP BY t, block""",
    "index_build": f"WITH {_grams('documents', 'doc_id', 'text')} SELECT (SELECT count(*) FROM documents) AS files, count(DISTINCT t) AS distinct_trigrams, count(*) AS pairs FROM g",
    "index_summary": f"""WITH {_grams("documents", "doc_id", "text")}, k AS (SELECT t, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY t, doc_id // 65536 ORDER BY doc_id) AS gap FROM g)
        SELECT (SELECT count(*) FROM documents) AS files, count(DISTINCT t) AS distinct_trigrams, count(*) AS pairs, sum({_BITS})::BIGINT AS bytes FROM k""",
    "search_literal": _hit_sql("license", _ALL),
    "search_regex": _hit_sql("tion.*heit", _ALL),
    "search_ignore_case": _hit_sql("THAND", _ALL, "i"),
    "search_scan_fallback": _hit_sql("[0-9]{3}-[0-9]{4}", _ALL),
    "search_crlf": f"WITH {_NEW}, {_lines('snew', 'doc_id', 'content', 'NOT (' + _CONTROL + ')')} SELECT doc_id, lineno, regexp_replace(raw, '\\r$', '') AS line FROM l WHERE regexp_matches(raw, 'en\\.$')",
    "candidate_selectivity": " UNION ALL ".join([_selectivity_sql("license", ["lic", "ice", "cen", "ens", "nse"]), _selectivity_sql("tion.*heit", ["tio", "ion", "hei", "eit"]), _selectivity_sql("thand", ["tha", "han", "and"])]),
    "rarest_trigrams": f"WITH {_grams('documents', 'doc_id', 'text')} SELECT {_NUMBER} AS trigram, count(*) AS df FROM g WHERE t IN ('746861', '68616E', '616E64', '74696F', '696F6E') GROUP BY t ORDER BY df, trigram LIMIT 3",
    "hits_per_file": _hit_sql("license", "SELECT doc_id, count(*) AS n_lines FROM hit GROUP BY doc_id"),
    "hit_totals": _hit_sql("thand", "SELECT count(*) AS n_lines, count(DISTINCT doc_id) AS n_files FROM hit"),
    "hits_grouped": _hit_sql("license", "SELECT doc_id, doc_id || chr(10) || string_agg(lineno || ':' || line, chr(10) ORDER BY lineno) AS value FROM hit GROUP BY doc_id"),
    "first_hit_per_file": _hit_sql("thand", "SELECT doc_id, lineno, line FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lineno) = 1"),
    "first_hits": _hit_sql("thand", "SELECT doc_id, lineno, line FROM hit ORDER BY doc_id, lineno LIMIT 10"),
    "hits_flat_text": _hit_sql("license", "SELECT doc_id || ':' || lineno || ':' || line AS value FROM hit"),
    "hits_highlighted": _hit_sql("thand", "SELECT doc_id, lineno, replace(line, 'thand', '[thand]') AS shown FROM hit"),
    "match_spans": _hit_sql(
        "an[dt]h?",
        """, m AS (SELECT doc_id, lineno, regexp_extract_all(line, 'an[dt]h?') AS f, string_split_regex(line, 'an[dt]h?') AS s FROM hit),
        e AS (SELECT doc_id, lineno, f, s, unnest(range(1, len(f) + 1)) AS i FROM m),
        p AS (SELECT doc_id, lineno, (i - 1)::INT AS k, (length(array_to_string(s[1:i], '')) + length(array_to_string(f[1:i - 1], '')))::INT AS start, f[i] AS text FROM e)
        SELECT doc_id, lineno, k, start, (start + length(text))::INT AS "end", text FROM p""",
    ),
    "batch_patterns": f"WITH {_lines('documents', 'doc_id', 'text')}, p(pattern_id, pattern) AS (VALUES "
    + ", ".join(f"({k}, '{v}')" for k, v in PATTERNS.items())
    + ") SELECT pattern_id, doc_id, count(*) AS n_lines FROM p JOIN l ON regexp_matches(raw, pattern) GROUP BY ALL",
    "diff_status": f"""WITH {_NEW}, {_OLD}, {_STORED}, {_DIFF} SELECT path, status, "by" FROM d WHERE status <> 'ignored'""",
    "diff_stats": f"WITH {_NEW}, {_OLD}, {_STORED}, {_DIFF} SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("added", "changed", "removed", "unchanged")) + " FROM d",
    "assigned_ids": f"WITH {_OLD}, {_STORED} SELECT path, row_number() OVER (ORDER BY path) AS file_id FROM stored",
    "postings_delta": _DELTA + f" SELECT {_NUMBER} AS trigram, count(*) AS n_new FROM x GROUP BY t",
    "lists_rewritten": _DELTA + " SELECT count(DISTINCT t) AS trigrams_rewritten FROM x",
    "stale_postings": f"""WITH {_NEW}, {_OLD}, {_STORED}, {_DIFF}, r AS (SELECT path, old_content FROM d WHERE status = 'removed'), {_grams("r", "path", "old_content", "gr")},
        c AS (SELECT path, old_content, new_content FROM d WHERE status = 'changed'), {_grams("c", "path", "old_content", "ga")}, {_grams("c", "path", "new_content", "gb")}
        SELECT * FROM (SELECT 'tombstone' AS cause, count(*) AS pairs FROM gr UNION ALL SELECT 'lost_trigram', count(*) FROM (SELECT * FROM ga EXCEPT SELECT * FROM gb)) WHERE pairs > 0""",
    "postings_intersect": _pairs_sql("AND", ""),
    "postings_merge": _pairs_sql("OR", ", bool_or(contains(text, b) AND NOT contains(text, a)) AS changed"),
    "posting_gaps": f"WITH {_grams('documents', 'doc_id', 'text')}, k AS (SELECT t, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY t ORDER BY doc_id) AS gap FROM g) SELECT {_NUMBER} AS trigram, max(gap) AS widest, count(*) AS n FROM k GROUP BY t",
    "path_fnv1a64": f"""WITH {_NEW}, h AS (SELECT path, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(regexp_extract_all(hex(encode(path)), '..'), lambda x: ('0x' || x)::HUGEINT)),
        lambda a, x: xor(a, x) * 1099511628211 % 18446744073709551616) AS v FROM snew) SELECT path, (CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END)::BIGINT AS hash FROM h""",
    "search_after_update": f"""WITH {_NEW}, {_OLD}, {_STORED}, n AS (SELECT *, {_REASON} AS reason FROM snew),
        {_lines("(SELECT n.path, n.content, s.content AS old FROM n LEFT JOIN stored s USING (path) WHERE NOT contains(n.content, chr(0)) AND NOT (" + _CONTROL.replace("content", "n.content") + "))", "path", "content")},
        hit AS (SELECT path, lineno, regexp_replace(raw, '\\r$', '') AS line FROM l WHERE contains(raw, 'license'))
        SELECT 1 AS step, hit.* FROM hit JOIN stored USING (path) WHERE contains(content, 'lic') AND contains(content, 'ice') AND contains(content, 'cen') AND contains(content, 'ens') AND contains(content, 'nse')
        UNION ALL SELECT 2, hit.* FROM hit JOIN n USING (path) WHERE reason = 'ok'""",
    "compacted_index": f"""WITH {_NEW}, {_OLD}, {_STORED}, n AS (SELECT * FROM (SELECT *, {_REASON} AS reason FROM snew) WHERE reason = 'ok'), {_grams("n", "path", "content", "gn")}, {_grams("stored", "path", "content", "go")}
        SELECT 'updated' AS state, (SELECT count(*) FROM n) AS files, (SELECT count(*) FROM (SELECT * FROM gn UNION SELECT * FROM go)) AS pairs
        UNION ALL SELECT 'compacted', (SELECT count(*) FROM n), (SELECT count(*) FROM gn)""",
    "live_candidates": f"""WITH {_NEW}, {_OLD}, {_STORED}, n AS (SELECT * FROM (SELECT *, {_REASON} AS reason FROM snew) WHERE reason = 'ok')
        SELECT n.path FROM n LEFT JOIN stored s USING (path) WHERE (contains(n.content, 'tio') OR contains(coalesce(s.content, ''), 'tio')) AND (contains(n.content, 'ion') OR contains(coalesce(s.content, ''), 'ion'))""",
    "posting_list_ids": "SELECT doc_id FROM documents WHERE contains(text, 'lic')",
    "file_by_id": "SELECT doc_id AS file_id, doc_id::VARCHAR AS path, strlen(text) AS size FROM documents WHERE doc_id = 7",
    "packed_heads": "SELECT doc_id, ('0x' || left(hex(encode(text)), 6))::INTEGER AS trigram FROM documents WHERE strlen(text) >= 3",
    "shown_paths": f"WITH {_NEW} SELECT path, 'corpus/' || path AS below, path AS plain FROM snew",
    "codec_roundtrip": f"""WITH {_grams("documents", "doc_id", "text")}, k AS (SELECT t, doc_id, doc_id // 65536 AS block, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY t, doc_id // 65536 ORDER BY doc_id) AS gap FROM g)
        SELECT {_NUMBER} AS trigram, count(*) AS n, true AS ok, NULL::VARCHAR AS error, sum({_BITS})::BIGINT AS bytes FROM k GROUP BY t, block""",
    "stream_search": _hit_sql("license", _ALL),
}
_PATTERN = ITEM_PATTERN.format(g=", 'g'")
ORACLES |= {
    "tree_rejections": f"WITH {_NEW} SELECT * FROM (SELECT path, strlen(content) AS size, {_REASON} AS reason, 0::BIGINT AS opened_again FROM snew) WHERE reason <> 'ok'",
    "tree_skips": f"WITH {_NEW}, {_OLD} SELECT path, count(*) OVER () AS counted FROM (SELECT DISTINCT path FROM sold WHERE path NOT IN (SELECT path FROM snew))",
    "resumed_build": f"WITH {_NEW} SELECT path, row_number() OVER (ORDER BY path) AS file_id, false AS seen_early FROM (SELECT *, {_REASON} AS reason FROM snew) WHERE reason = 'ok'",
    "appended_levels": f"WITH {_grams('documents', 'doc_id', 'text')} SELECT {_NUMBER} AS trigram, count(*) AS df, 2::BIGINT AS generations FROM g GROUP BY t",
    "index_sketch": f"WITH {_grams('documents', 'doc_id', 'text')} SELECT count(DISTINCT t) AS lists, true AS close FROM g",
    "forward_delta": ORACLES["postings_delta"],
    "root_keys": ORACLES["path_fnv1a64"].rpartition("SELECT path, (CASE")[0] + "SELECT path, lpad(lower(to_hex(v::UBIGINT)), 16, '0') AS key FROM h",
    "pattern_table": f"WITH {_lines('documents', 'doc_id', 'text')}, p AS (SELECT item_id, {_PATTERN} AS pattern FROM benchmark) SELECT item_id, doc_id, count(*) AS n_lines FROM p JOIN l ON regexp_matches(raw, pattern) GROUP BY ALL",
    "hits_in_order": _hit_sql("license", "SELECT doc_id, lineno, row_number() OVER (ORDER BY doc_id, lineno) AS place FROM hit"),
}
ORACLES["stream_index"] = ORACLES["trigram_df"]
