"""Posting lists: which files hold a trigram.

Lists are blocked: the ids of one trigram are kept per range of ``BLOCK`` file ids, so the
commonest trigram of the largest corpus never makes a list of more than BLOCK ids, and
intersections run block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec

BLOCK = 65536
BUCKETS = 64
#: Blocks whose lists of a bucket are merged and written by one task.
SPAN = 4
#: File ids of one partition of the forward table.
FORWARD = 4096
#: Bytes of encoded lists that are decoded together.
_DECODED = 1 << 20
#: Bytes of text whose lists one task joins, about; where that makes more tasks than Spark's number of shuffle partitions.
_TASK = 16 << 20


def _dealt(lists: DataFrame, size: int, *by: str) -> DataFrame:
    """Lists of ``size`` bytes of text (0: not known) dealt out by some columns, to more tasks the more text there is."""
    parts = -(-size // _TASK)
    return lists.repartition(parts, *by) if parts > int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")) else lists.repartition(*by)


def short_lists(files: DataFrame) -> DataFrame:
    """(trigram, block, ids) of (file_id, content), in short lists.

    Each task inverts the files of a batch on its own, so what is shuffled next is one list for
    each trigram and batch, not one row for each pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            sizes = np.array([len(c.as_buffer()) if c.is_valid else 0 for c in batch.column("content")], dtype=np.int64)
            group = np.cumsum(sizes) // (4 << 20)
            for stop in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]:
                yield from _inverted_batch(batch.slice(at, stop - at))
                at = stop

    return files.select("file_id", F.col("content").cast("binary").alias("content")).mapInArrow(run, "trigram int, block long, ids array<long>")


def joined_lists(lists: DataFrame, small: bool = False, size: int = 0) -> DataFrame:
    """Blocked form (tbucket, trigram, block, ids) of lists that may be in several parts; ids ascend.

    One shuffle, by bucket and span of blocks, joins the parts and puts together what
    goes to one file, so an index of any size has as many tasks as it has spans and buckets. ``small``
    lists are the work of one task; ``size`` is that of their text, if known.
    """
    keyed = lists.select((F.col("trigram") % BUCKETS).alias("tbucket"), F.floor(F.col("block") / SPAN).alias("span"), "trigram", "block", "ids")
    dealt = keyed.repartition(1) if small else _dealt(keyed, size, "tbucket", "span")
    whole = dealt.groupBy("tbucket", "span", "trigram", "block").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    return whole.drop("span")


def inverted(files: DataFrame, size: int = 0) -> DataFrame:
    """Blocked form (tbucket, trigram, block, ids) of (file_id, content), of ``size`` bytes if known; ids ascend."""
    return joined_lists(short_lists(files), size=size)


def _inverted_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids = batch.column("file_id").to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    content = batch.column("content")
    blocks, edges = np.unique(ids[order] // BLOCK, return_index=True)
    for block, own in zip(blocks, np.split(order, edges[1:]), strict=True):
        keys = []
        for place, k in enumerate(own):
            value = content[int(k)]
            if value.is_valid:
                found = codec.packed(np.frombuffer(value.as_buffer(), np.uint8))
                keys.append(np.unique(found).astype(np.int64) << 32 | place)
        if not keys:
            continue
        keys = np.sort(np.concatenate(keys))
        trigram, place = (keys >> 32).astype(np.int32), keys & 0xFFFFFFFF
        edge = np.flatnonzero(np.diff(trigram, prepend=-1))
        offsets = np.append(edge, len(keys)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[own][place]))
        yield pa.RecordBatch.from_arrays([pa.array(trigram[edge]), pa.array(np.full(len(edge), block, np.int64)), lists], names=["trigram", "block", "ids"])


def document_frequency(postings: DataFrame) -> DataFrame:
    """(trigram, df)"""
    return postings.groupBy("trigram").agg(F.sum(F.size("ids")).cast("long").alias("df"))


def posting_list(postings: DataFrame, trigram: int) -> DataFrame:
    """(file_id) of one trigram, empty if it is absent."""
    return postings.filter((F.col("tbucket") == trigram % BUCKETS) & (F.col("trigram") == trigram)).select(F.explode("ids").alias("file_id")).distinct()


def candidates(postings: DataFrame, required: list[int] | tuple[int, ...]) -> DataFrame:
    """(file_id) of files that hold all of ``required``.

    Filters prune buckets and row groups; a block's lists are intersected in place, so
    what is shuffled is the lists of a handful of trigrams.
    """
    required = list(required)
    some = postings.filter(F.col("tbucket").isin(sorted({t % BUCKETS for t in required})) & F.col("trigram").isin(required))
    # one shuffle serves both groupings
    whole = some.repartition("block").groupBy("block", "trigram").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    lists = whole.groupBy("block").agg(F.collect_list("ids").alias("lists")).filter(F.size("lists") == len(required))
    both = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.col("lists")[0], lambda a, x: F.array_intersect(a, x))
    return lists.select(F.explode(both).alias("file_id"))


def rarest(stats: DataFrame, required: list[int], most: int) -> list[int] | None:
    """The ``most`` rarest of the required trigrams, or None if one is absent (no candidate).

    Any subset narrows soundly; the rarest do so most.
    """
    found = stats.filter(F.col("trigram").isin(list(required))).groupBy("trigram").agg(F.sum("df").alias("df")).orderBy("df", "trigram").collect()
    return [r["trigram"] for r in found][:most] if len(found) == len(set(required)) else None


def _met(lists: DataFrame, other: DataFrame, made, size: int) -> DataFrame:
    """(trigram, block, ids) of two tables of lists, which may be in parts: ``made`` of both lists, where it holds any id.

    One shuffle of lists; no row is made for a pair, and a row of the result has at most BLOCK ids.
    """
    none = F.lit(None).cast("array<long>")
    both = lists.select("trigram", "block", F.col("ids").alias("one"), none.alias("other")).unionByName(other.select("trigram", "block", none.alias("one"), F.col("ids").alias("other")))
    grouped = _dealt(both, size, "trigram", "block").groupBy("trigram", "block").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("one", "other")])
    return grouped.select("trigram", "block", F.sort_array(made(F.col("one"), F.col("other"))).alias("ids")).filter(F.size("ids") > 0)


def lacking(lists: DataFrame, old: DataFrame, changed: DataFrame | None = None, size: int = 0) -> DataFrame:
    """(trigram, block, ids) of what ``lists`` hold and the old lists lack.

    With ``changed`` (file_id) only the old lists' ids of these files are looked at: ids of
    added files can't be in them. A list is intersected with its block's changed ids before it
    is shuffled. ``size`` is that of the lists' text, if known.
    """
    known = old.select("trigram", "block", "ids")
    if changed is not None:
        # at most BLOCK ids a row
        blocks = changed.groupBy(F.floor(F.col("file_id") / BLOCK).cast("long").alias("block")).agg(F.collect_set("file_id").alias("changed"))
        known = old.join(blocks, "block").select("trigram", "block", F.array_intersect("ids", "changed").alias("ids")).filter(F.size("ids") > 0)
    return _met(lists, known, F.array_except, size)


def in_both(lists: DataFrame, other: DataFrame, size: int = 0) -> DataFrame:
    """(trigram, block, ids) of what both tables of lists hold."""
    return _met(lists, other, F.array_intersect, size)


def forward_rows(files: DataFrame) -> DataFrame:
    """(fblock, file_id, trigrams): the sorted trigrams of each of (file_id, content), in spans of ``FORWARD`` ids."""
    span = F.floor(F.col("file_id") / FORWARD).cast("long")
    return files.select(span.alias("fblock"), "file_id", codec.trigrams("content").alias("trigrams"))


def forward_delta(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs (trigram, file_id) of (file_id, trigrams) that the old rows lack: one array difference a file."""
    both = new.join(old.select("file_id", F.col("trigrams").alias("before")), "file_id", "left")
    gained = F.when(F.col("before").isNull(), F.col("trigrams")).otherwise(F.array_except("trigrams", "before"))
    return both.select(F.explode(gained).alias("trigram"), "file_id")


def listed(pairs: DataFrame) -> DataFrame:
    """(trigram, block, ids) of pairs (trigram, file_id)."""
    return pairs.groupBy("trigram", F.floor(F.col("file_id") / BLOCK).cast("long").alias("block")).agg(F.collect_list("file_id").alias("ids"))


def stale(postings: DataFrame, lists: DataFrame, files: DataFrame, size: int = 0) -> DataFrame:
    """(cause, pairs): indexed pairs that ``lists`` no longer hold, by tombstone or lost trigram."""
    gone = lacking(postings, lists, size=size).select(F.explode("ids").alias("file_id")).groupBy("file_id").agg(F.count("*").alias("pairs"))
    live = files.select("file_id", F.lit(True).alias("live"))
    cause = F.when(F.col("live"), "lost_trigram").otherwise("tombstone")
    return gone.join(live, "file_id", "left").groupBy(cause.alias("cause")).agg(F.sum("pairs").alias("pairs"))


def id_gaps(pairs: DataFrame) -> DataFrame:
    """Long form with each id's distance to the one before it in its list."""
    before = F.lag("file_id", 1, 0).over(Window.partitionBy("trigram").orderBy("file_id"))
    return pairs.withColumn("gap", F.col("file_id") - before)


def validated(encoded: DataFrame, column: str = "encoded") -> DataFrame:
    """Rows with ``ids`` and ``error`` of an encoded list column; damaged rows have an error.

    Lists are decoded and sent on about ``_DECODED`` bytes at a time, as a batch of blobs becomes eight times as large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            edges = np.flatnonzero(np.diff(np.cumsum(sizes) // _DECODED)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                piece = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*piece.columns, *codec.decoded(piece.column(column))], names=[*piece.schema.names, "ids", "error"])

    schema = T.StructType([*encoded.schema.fields, T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("error", T.StringType())])
    return encoded.mapInArrow(run, schema)
