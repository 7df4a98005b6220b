"""A stored index: generations of Parquet tables, named by numbered manifests.

    <base>/manifest-<number>.json       what counts: root, generations, next file id, unfinished build
    <base>/<generation>/files           file_id, path, mtime_ns, size, content_hash, reason
    <base>/<generation>/gone            path: rows of earlier generations that no longer hold
    <base>/<generation>/postings        tbucket (partition of large ones), trigram, block, ids
    <base>/<generation>/stats           trigram, df
    <base>/<generation>/sketch          sketches of the distinct trigrams and of the lists' lengths
    <base>/<generation>/forward         fblock (partition), file_id, trigrams; with ``forward`` only

The manifest with the highest number counts, and a commit makes the next number unless it is there
already. A writer that finds it there starts from the newer manifest again, so of writers at
the same time none is lost. A generation that no manifest names does not exist for readers. The
last ``keep`` manifests and what they name stay, so a search that began before a build, merge or
compaction can end after it.

Files that were listed and turned out not to be text stay in ``files`` without an id and with the
reason, and are not read again until their size or time changes. Ids are never reused. Updates append
generations; ids of removed files stay in the lists and lose their row in ``files``, until ``compact``
or a new build. Generations have levels: ``FANOUT`` of one level become one of the next, so a
posting is written again about log N times in N updates.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.files import stat_reason
from ..operators import postings as P
from ..operators import update as U
from ..shared import Store, checkpointed
from .corpus import Corpus, Table, Tree, as_corpus

FANOUT = 8
ENTRIES = f"{U.FILES}, reason string"
LISTS = "trigram int, block long, ids array<long>, tbucket int"
SKETCH = "trigrams binary, lengths binary"
FORWARD = "file_id long, trigrams array<int>, fblock long"
#: Changed files whose ids are pushed into the scan of the forward table, at most.
_PUSHED = 1000
#: Bytes of a table's text for each core, up to which it is dealt out anew before it is inverted.
_LITTLE = 32 << 20
#: Bytes of text whose lists are one task's work, and whose lists are not worth a folder for each bucket.
_SMALL, _PLAIN = 4 << 20, 1 << 30


@dataclass(frozen=True)
class Pieces:
    """How much of a tree one generation of a build takes in: the shares of all three together make one piece."""

    files: int = 1_000_000
    bytes: int = 256 << 30
    #: Of a file at most as many as it has bytes, or as there are.
    trigrams: int = 1 << 33


class Index:
    """``forward`` keeps each file's trigrams beside the lists, for updates that read them instead of lists."""

    def __init__(self, spark: SparkSession, base: str, root: str, forward: bool = False, keep: int = 8):
        self.spark, self.root, self.forward, self.keep = spark, root, forward, keep
        self.store = Store(spark, base)

    # --- manifests

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for m in (re.fullmatch(r"manifest-(\d+)\.json", n) for n in self.store.names()) if m)

    def _named(self, number: int) -> dict | None:
        text = self.store.read(f"manifest-{number:012}.json")
        return json.loads(text) if text else None

    def _latest(self) -> dict:
        """The newest manifest if it is of this root, else one that holds nothing yet, with the newest's number."""
        empty = {"root": self.root, "number": 0, "generations": None, "last_id": 0, "streams": {}, "building": None}
        while numbers := self._numbers():
            if found := self._named(numbers[-1]):
                return found if found["root"] == self.root else empty | {"number": found["number"]}
        return empty

    def manifest(self) -> dict | None:
        """None if nothing was built whole, or what was built is of another corpus."""
        found = self._latest()
        return found if found["generations"] is not None else None

    def _opened(self, manifest: dict | None = None) -> dict:
        manifest = manifest or self.manifest()
        if manifest is None:
            raise FileNotFoundError(f"no index of {self.root} at {self.store.base}")
        return manifest

    def _commit(self, before: dict, change: dict) -> bool:
        """Make the manifest that follows ``before``; False if another writer has made it."""
        after = before | change | {"number": before["number"] + 1}
        if not self.store.create(f"manifest-{after['number']:012}.json", json.dumps(after)):
            return False
        self._forget(after["number"] - self.keep)
        return True

    def _amend(self, change: Callable[[dict], dict]) -> None:
        """Commit a change that can be made to whatever is there."""
        while not self._commit(before := self._latest(), change(before)):
            pass

    @staticmethod
    def _names(manifest: dict) -> set[str]:
        building = manifest["building"] or {"done": [], "plan": None}
        return {g["name"] for g in [*(manifest["generations"] or []), *building["done"]]} | ({building["plan"]} - {None})

    def _forget(self, upto: int) -> None:
        """Delete manifests up to a number, and what only they name."""
        numbers = self._numbers()
        old = [m for n in numbers if n <= upto and (m := self._named(n))]
        held = set().union(*(self._names(m) for n in numbers if n > upto and (m := self._named(n))))
        for manifest in old:
            for name in self._names(manifest) - held:
                self.store.delete(name)
            self.store.delete(f"manifest-{manifest['number']:012}.json")

    # --- what is stored

    def _read(self, generations: list[dict], part: str, schema: str, counted: str) -> DataFrame:
        """The rows of one table of those generations that have any, with ``seq``, the generation's place."""
        parts = [self.spark.read.schema(schema).parquet(self.store.at(g["name"], part)).withColumn("seq", F.lit(k)) for k, g in enumerate(generations) if g[counted]]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, seq int")

    def _entries(self, generations: list[dict]) -> DataFrame:
        """What holds of ``files``: rows that no later generation replaces."""
        rows = self._read(generations, "files", ENTRIES, "files")
        if any(g["gone"] for g in generations[1:]):
            gone = self._read(generations, "gone", "path string", "gone").select(F.col("path").alias("was"), F.col("seq").alias("until"))
            rows = rows.join(gone, (F.col("path") == F.col("was")) & (F.col("until") > F.col("seq")), "left_anti")
        return rows.drop("seq")

    def files(self, manifest: dict | None = None) -> DataFrame:
        return self._entries(self._opened(manifest)["generations"]).filter("file_id is not null").drop("reason")

    def rejected(self, manifest: dict | None = None) -> DataFrame:
        """(path, mtime_ns, size, reason) of files that were found not to be text."""
        return self._entries(self._opened(manifest)["generations"]).filter("file_id is null").select("path", "mtime_ns", "size", "reason")

    def file(self, file_id: int) -> DataFrame:
        """One file's row; none for an id that was removed."""
        return self.files().filter(F.col("file_id") == file_id)

    def postings(self, manifest: dict | None = None) -> DataFrame:
        return self._read(self._opened(manifest)["generations"], "postings", LISTS, "lists").drop("seq")

    def stats(self, manifest: dict | None = None) -> DataFrame:
        read = self._read(self._opened(manifest)["generations"], "stats", "trigram int, df long", "lists")
        return read.groupBy("trigram").agg(F.sum("df").alias("df"))

    def trigrams_of(self, file_ids: list[int], manifest: dict | None = None) -> DataFrame:
        """(file_id, trigrams) of some files from the forward table; a file's newest row counts."""
        rows = self._read(self._opened(manifest)["generations"], "forward", FORWARD, "forward")
        rows = rows.filter(F.col("fblock").isin(sorted({k // P.FORWARD for k in file_ids})) & F.col("file_id").isin(file_ids))
        return rows.groupBy("file_id").agg(F.max_by("trigrams", "seq").alias("trigrams"))

    def approximate(self) -> DataFrame:
        """One row, by the generations' sketches alone: distinct_trigrams, lists, and the median and 99th percentile of their lengths."""
        rows = self._read(self._opened()["generations"], "sketch", SKETCH, "lists")
        both = rows.agg(F.hll_union_agg("trigrams").alias("t"), F.kll_merge_agg_bigint("lengths").alias("l"))
        return both.select(
            F.coalesce(F.hll_sketch_estimate("t"), F.lit(0)).cast("long").alias("distinct_trigrams"),
            F.kll_sketch_get_n_bigint("l").alias("lists"),
            *[F.kll_sketch_get_quantile_bigint("l", F.lit(q)).alias(name) for q, name in ((0.5, "median_length"), (0.99, "p99_length"))],
        )

    # --- generations

    def _write(self, kind: str, files: DataFrame, lists: DataFrame | None, gone: DataFrame | None = None, forward: DataFrame | None = None, level: int | None = None) -> dict:
        """Write a generation that no manifest names yet: what the manifest will say of it."""
        name = f"{kind}-{uuid.uuid4().hex}"
        files.select("file_id", "path", "mtime_ns", "size", "content_hash", "reason").write.parquet(self.store.at(name, "files"))
        written = self.spark.read.schema(ENTRIES).parquet(self.store.at(name, "files"))
        count, last, size = written.agg(F.count("*"), F.max("file_id"), F.sum(F.when(F.col("file_id").isNotNull(), F.col("size")))).first()
        out = {"name": name, "files": count, "last": last or 0, "gone": 0, "lists": 0, "forward": int(forward is not None), "bytes": 0}
        if gone is not None:
            gone.select("path").write.parquet(self.store.at(name, "gone"))
            out["gone"] = self.spark.read.schema("path string").parquet(self.store.at(name, "gone")).count()
        if lists is not None:
            # few lists are one file, and not very many a file a task: sorted, so that row groups are skipped as folders are
            table = P.joined_lists(lists, (size or 0) <= _SMALL, size or 0).sortWithinPartitions("tbucket", "trigram", "block")
            (table.write if (size or 0) <= _PLAIN else table.write.partitionBy("tbucket")).parquet(self.store.at(name, "postings"))
            written = self.spark.read.schema(LISTS).parquet(self.store.at(name, "postings"))
            P.document_frequency(written).write.parquet(self.store.at(name, "stats"))
            stats = self.spark.read.schema("trigram int, df long").parquet(self.store.at(name, "stats"))
            # one row of a few kilobytes
            row = stats.agg(F.hll_sketch_agg("trigram", 14).alias("trigrams"), F.kll_sketch_agg_bigint("df").alias("lengths"), F.count("*").alias("n")).first()
            self.spark.createDataFrame([(row["trigrams"], row["lengths"])], SKETCH).coalesce(1).write.parquet(self.store.at(name, "sketch"))
            out["lists"], out["bytes"] = row["n"], self.store.size(name, "postings")
        if forward is not None:
            sorted_rows = forward.repartition("fblock").sortWithinPartitions("fblock", "file_id")
            # short pages, so that a scan for one file skips those beside it
            sorted_rows.write.option("parquet.page.row.count.limit", "16").partitionBy("fblock").parquet(self.store.at(name, "forward"))
        return out | {"level": math.ceil(math.log(max(1, count), FANOUT)) if level is None else level}

    def _rejected(self, judged: DataFrame) -> DataFrame:
        return judged.filter("reason not in ('ok', 'unreadable')").select(F.lit(None).cast("long").alias("file_id"), "path", "mtime_ns", "size", F.lit(None).cast("long").alias("content_hash"), "reason")

    def _taken_in(self, corpus: Corpus, rows: DataFrame | None, after: int, ids: str | None = None) -> tuple[dict, int]:
        """A generation of some listed rows (else of all), with ids after ``after``.

        Without ``ids`` a table's content is joined to the ids of its paths: a broadcast of these while Spark
        takes them for small, else a shuffle of the content.
        """
        workers = self.spark.sparkContext.defaultParallelism
        if isinstance(corpus, Table):
            corpus = corpus.dealt(workers, workers * _LITTLE)
        judged = corpus.judged(rows)
        meta = checkpointed(judged.select("path", "mtime_ns", "size", F.xxhash64("content").alias("content_hash"), "reason", *([F.col(ids).cast("long").alias("file_id")] if ids else [])))
        ok = meta.filter("reason = 'ok'")
        numbered = (ok if ids else U.with_ids(ok, after)).withColumn("reason", F.lit(None).cast("string"))
        if ids:
            content = judged.filter("reason = 'ok'").select(F.col(ids).cast("long").alias("file_id"), "content")
        else:
            content = corpus.reading(numbered.select("path", "size", "file_id"), ok.count())
        record = self._write("gen", numbered.unionByName(self._rejected(meta), allowMissingColumns=True), P.short_lists(content), forward=P.forward_rows(content) if self.forward else None)
        return record, max(after, record["last"])

    def _cut(self, files: DataFrame, pieces: Pieces) -> DataFrame:
        """Listed files with ``piece``: in the order of paths, by running sums of files, bytes and possible trigrams."""
        load = F.lit(1 / pieces.files) + F.col("size") / pieces.bytes + F.least("size", F.lit(1 << 24)) / pieces.trigrams
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        placed = checkpointed(files.withColumn("load", load).repartitionByRange(parts, "path").withColumn("__p", F.spark_partition_id()))
        own = F.sum("load").over(Window.partitionBy("__p").orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
        sums = placed.groupBy("__p").agg(F.sum("load").alias("all"))  # a row a partition
        before = sums.select("__p", F.coalesce(F.sum("all").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
        return placed.join(before, "__p").withColumn("piece", F.floor(F.col("before") + F.coalesce(own, F.lit(0.0))).cast("int")).drop("__p", "load", "before")

    def build(self, corpus: Corpus | DataFrame, ids: str | None = None, pieces: Pieces | None = None, fresh: bool = False) -> None:
        """A full build; readers see the old index until the new one is whole.

        A tree's listing is frozen and cut into pieces in the order of paths, and each piece becomes
        a generation; a build that was cut off goes on with the first piece that has none, unless it
        is to start ``fresh``. Content is read twice, to tell what is text and to invert it. Ids
        follow the order of paths, or are taken from a column of the corpus (a table). A table
        is one piece unless ``pieces`` are given.
        """
        corpus = as_corpus(corpus)
        if ids or (pieces is None and not isinstance(corpus, Tree)):
            record, last = self._taken_in(corpus, None, 0, ids)
            self._amend(lambda m: {"generations": [record], "last_id": last, "streams": {}, "building": None})
            return
        building = None if fresh else self._latest()["building"]
        if building is None:
            plan = f"plan-{uuid.uuid4().hex}"
            files = corpus.entries().filter("kind = 'file'").drop("kind")
            self._cut(files, pieces or Pieces()).write.partitionBy("piece").parquet(self.store.at(plan))
            listed = self.spark.read.schema("path string, mtime_ns long, size long, piece int").parquet(self.store.at(plan))
            numbers = sorted(r[0] for r in listed.select("piece").distinct().collect())
            building = {"plan": plan, "pieces": numbers, "done": [], "last_id": 0}
            self._amend(lambda m: {"building": building})
        listed = self.spark.read.schema("path string, mtime_ns long, size long, piece int").parquet(self.store.at(building["plan"]))
        for number in building["pieces"][len(building["done"]) :]:
            record, last = self._taken_in(corpus, listed.filter(F.col("piece") == number).drop("piece"), building["last_id"])
            building = building | {"done": [*building["done"], record], "last_id": last}
            self._amend(lambda m, now=building: {"building": now})
        self._amend(lambda m: {"generations": building["done"], "last_id": building["last_id"], "streams": {}, "building": None})

    def update(self, corpus: Corpus | DataFrame, manifest_paths: DataFrame | None = None, keep_unlisted: bool = True) -> dict[str, int]:
        """Bring the index up to the corpus; counts of what changed.

        Only files that are new or whose size or time differs are read, and not those that their
        name or size rules out; changed ones keep their ids, and only genuinely new pairs
        are appended. A root that can't be listed raises and changes nothing. What could not be listed or
        read, and paths of ``manifest_paths`` that the corpus lacks, count as skipped_unreadable; stored
        files below a folder that could not be listed stay, or go without ``keep_unlisted``.
        """
        corpus = as_corpus(corpus)
        while True:
            manifest = self.manifest()
            entries = checkpointed(corpus.entries())
            listed = entries.filter("kind = 'file'")
            skipped = entries.count() - listed.count()
            if manifest_paths is not None:
                skipped += manifest_paths.select("path").distinct().join(listed.select("path"), "path", "left_anti").count()
            if manifest is None:
                self.build(corpus)
                return {"added": self.files().count(), "changed": 0, "removed": 0, "unchanged": 0, "trigrams_rewritten": self.stats().count(), "skipped_unreadable": skipped}
            changes = checkpointed(U.diff(corpus, self.files(manifest), self.rejected(manifest), entries, keep_unlisted))
            stats = {"trigrams_rewritten": 0} | U.counts(changes).first().asDict()
            stats["skipped_unreadable"] = skipped + changes.filter("reason = 'unreadable'").count()
            moved = changes.filter("moved")
            if moved.isEmpty():
                return stats
            added = checkpointed(U.with_ids(moved.filter("status = 'added'").drop("file_id"), manifest["last_id"]))
            stays = moved.filter("status in ('unchanged', 'changed')").unionByName(added)
            rows = stays.withColumn("reason", F.lit(None).cast("string")).select("file_id", "path", "mtime_ns", "size", "content_hash", "reason").unionByName(self._rejected(moved.filter("listed")))
            lists = forward = None
            if stats["added"] or stats["changed"]:
                fresh = stays.filter("status in ('added', 'changed')").select("path", "size", "file_id")
                content = corpus.reading(fresh)
                changed = moved.filter("status = 'changed'").select("file_id")
                if self.forward:
                    forward = checkpointed(P.forward_rows(content))
                    few = [r[0] for r in changed.limit(_PUSHED + 1).collect()]
                    old = self.trigrams_of(few, manifest) if len(few) <= _PUSHED else self._read(manifest["generations"], "forward", FORWARD, "forward").join(changed, "file_id", "left_semi").groupBy("file_id").agg(F.max_by("trigrams", "seq").alias("trigrams"))
                    lists = checkpointed(P.listed(P.forward_delta(forward, old)))
                else:
                    lists = checkpointed(P.lacking(P.short_lists(content), self.postings(manifest), changed, fresh.agg(F.sum("size")).first()[0] or 0))
                stats["trigrams_rewritten"] = U.lists_rewritten(lists).first()[0]
            record = self._write("gen", rows, lists, moved.filter("known"), forward, level=0)
            if self._commit(manifest, {"generations": [*manifest["generations"], record], "last_id": max(manifest["last_id"], record["last"])}):
                self._merge_like()
                return stats
            self.store.delete(record["name"])  # another writer was first: again, from what it left

    def append(self, corpus: DataFrame, batch: int, stream: str = "stream") -> None:
        """Add a batch of new files as a generation of its own; a batch that is in already is left.

        For streams: batches of a stream are numbered upwards and paths are taken to be new.
        """
        while True:
            manifest = self._latest()
            done = manifest["streams"]
            if batch <= done.get(stream, -1):
                return
            record, last = self._taken_in(as_corpus(corpus), None, manifest["last_id"])
            held = manifest["generations"] or []
            grown = [*held, record | {"level": 0}] if record["files"] else held
            if self._commit(manifest, {"generations": grown, "last_id": last, "streams": done | {stream: batch}}):
                if record["files"]:
                    self._merge_like()
                else:
                    self.store.delete(record["name"])
                return
            self.store.delete(record["name"])

    # --- merging

    def _merged(self, generations: list[dict], level: int) -> dict:
        """One generation of several that follow one another; no content is read."""
        files = self._entries(generations)
        # earlier generations still need to know what these replaced
        gone = self._read(generations, "gone", "path string", "gone").select("path").distinct()
        lists = self._read(generations, "postings", LISTS, "lists").select("trigram", "block", "ids")
        forward = None
        if self.forward:
            forward = self._read(generations, "forward", FORWARD, "forward").groupBy("fblock", "file_id").agg(F.max_by("trigrams", "seq").alias("trigrams"))
        return self._write("gen", files, lists if any(g["lists"] for g in generations) else None, gone, forward, level)

    def _merge_like(self) -> None:
        """Merge the last generations while ``FANOUT`` of them have one level."""
        while True:
            manifest = self._opened()
            held = manifest["generations"]
            like = len(held)
            while like and held[like - 1]["level"] == held[-1]["level"]:
                like -= 1
            if len(held) - like < FANOUT:
                return
            record = self._merged(held[like:], held[-1]["level"] + 1)
            if not self._commit(manifest, {"generations": [*held[:like], record]}):
                self.store.delete(record["name"])

    def _alone(self, made: Callable[[dict], dict]) -> None:
        """Replace all generations by the one that is made of them."""
        while True:
            manifest = self._opened()
            record = made(manifest)
            if self._commit(manifest, {"generations": [record]}):
                return
            self.store.delete(record["name"])

    def merge(self) -> None:
        """One generation of what the index holds now; no content is read."""
        self._alone(lambda m: self._merged(m["generations"], math.ceil(math.log(max(1, sum(g["files"] for g in m["generations"])), FANOUT))))

    def compact(self, corpus: Corpus | DataFrame) -> None:
        """One generation without stale pairs; ids and files stay as they are."""
        corpus = as_corpus(corpus)

        def made(manifest: dict) -> dict:
            live = self.files(manifest).select("path", "size", "file_id")
            content = corpus.reading(live)
            true = P.in_both(self.postings(manifest), P.short_lists(content), live.agg(F.sum("size")).first()[0] or 0)
            return self._write("gen", self._entries(manifest["generations"]), true, forward=P.forward_rows(content) if self.forward else None)

        self._alone(made)


def summary(files: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: files, distinct_trigrams, pairs, and bytes of the lists as gap numbers."""
    from ..functions.codec import encoded_size

    lists = postings.agg(F.count_distinct("trigram").alias("distinct_trigrams"), F.sum(F.size("ids")).cast("long").alias("pairs"), F.sum(encoded_size(F.col("ids"))).cast("long").alias("bytes"))
    return lists.select(F.lit(files.count()).cast("long").alias("files"), "distinct_trigrams", "pairs", "bytes")


def _candidates(index: Index, corpus: Corpus, query, update: bool) -> DataFrame:
    """(path, size, file_id) of the files that can match, after what is asked of the index."""
    from ..operators import search as S

    if index.manifest() is None:
        index.build(corpus)
    elif update:
        index.update(corpus)
    manifest = index.manifest()
    live = index.files(manifest).select("path", "size", "file_id")
    chosen = S.narrowed(query, index.postings(manifest), index.stats(manifest))
    return live if chosen is None else live.join(chosen, "file_id", "left_semi")


def _texts(corpus: Corpus, rows: DataFrame) -> DataFrame:
    return corpus.reading(rows).select("file_id", "path", F.decode("content", "UTF-8").alias("text"))


def search_index(index: Index, corpus: Corpus | DataFrame, pattern: str, ignore_case: bool = False, update: bool = False, with_spans: bool = False) -> DataFrame:
    """Search a corpus through its index: built if there is none, brought up to date if asked, else as it is.

    Only the candidates' content is read, where the pattern has literals to narrow by.
    """
    from ..operators import search as S
    from ..plans.pattern import plan

    query = plan(pattern, ignore_case, index.spark)
    corpus = as_corpus(corpus)
    return S.hits_in(_texts(corpus, _candidates(index, corpus, query, update)), query, with_spans)


def first_in_index(index: Index, corpus: Corpus | DataFrame, pattern: str, n: int, ignore_case: bool = False, update: bool = False) -> DataFrame:
    """The first n hits of ``search_index`` in the order of ids and lines; candidates behind them are mostly not read."""
    from ..operators import search as S
    from ..plans.pattern import plan

    query = plan(pattern, ignore_case, index.spark)
    corpus = as_corpus(corpus)
    return S.first_hits_of(checkpointed(_candidates(index, corpus, query, update)), lambda rows: _texts(corpus, rows), query, n)


def root_key(root):
    """The name of a root's index: its FNV-1a hash as 16 hexadecimal digits."""
    from ..functions.codec import fnv1a64

    return F.lower(F.lpad(F.hex(fnv1a64(root)), 16, F.lit("0")))


def index_folder(base: str, root: str, spark: SparkSession) -> str:
    """The folder of a root's index: named by the FNV-1a hash of the root."""
    key = spark.createDataFrame([(root,)], "root string").select(root_key(F.col("root"))).first()[0]
    return f"{base.rstrip('/')}/{key}"
