"""Ranked lexical search by range-maximum sparse tables (operator 12).

Terms are maximal stretches of letters, digits and all that is not ASCII, A-Z lower-cased. Each
document's score for an item sums, over the item's terms with repeats, whole-number impacts as
``impacts`` states them; the k documents with the largest scores above zero are returned.

1. Items are dealt into slices of about ``slice_terms`` terms. One slice at a time is known to all
   tasks (its size is bounded by the slice), and each slice searches all documents.
2. Tasks split whole texts into terms and give, for each document, its number of terms and the
   slice's terms in it with their counts, compared byte by byte. Sums of these are the corpus' statistics.
3. Documents are dealt into spans, in the order of their keys within each, and searched ``block``
   documents (and about ``_POSTINGS`` postings) at a time. A block has a posting list for each term of the slice, by document,
   and over all lists one sparse table of the places of range maxima.
4. Best first: an interval of documents is bounded by the sum over the item's terms of the
   largest impact that each list has in it, found by two look-ups. The interval with the
   largest bound (a growing number of them together) is split at the document with the largest single
   contribution; that document is scored exactly, and what lies before and behind it are new
   intervals. The search ends when no bound reaches the k-th best score, which goes on from block to block.
5. The k best of each task meet in a window. Equal scores go to the smaller key.

Documents with a null key are not part of the collection. Null texts and texts without a term have no
term and count in no statistic. Items with a null key, or without a term that a document holds, have no
result; items that repeat a key are ranked each on their own. Repeated documents are documents of their
own. An empty table gives no result. Only keys and texts are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import checkpointed, table

#: A term, as a Java and RE2 regular expression.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Postings of a block, about; with its sparse tables one takes some 60 bytes.
_POSTINGS = 1 << 20


@dataclass(frozen=True)
class Ranking:
    k: int = 20
    #: Documents that are indexed together, and blocks that a task searches one after another.
    block: int = 4096
    span: int = 2
    slice_terms: int = 1 << 19


def impacts(weight: np.ndarray, count: np.ndarray, length: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a term of a weight adds to a document of ``length`` terms that holds it ``count`` times."""
    m = 75 + 25 * length * documents // terms
    return weight * (1_000_000_000 * count // (1000 * count + 12 * m))


class Vocabulary:
    """The terms of a slice, found in texts by 64-bit hashes and compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        self.data, starts = np.frombuffer(b"\n".join([*terms, b""]) or b"\n", np.uint8), np.cumsum([0, *(len(t) + 1 for t in terms)])
        self.start, self.size = starts[:-1], np.diff(starts) - 1
        begin, _, hashes = tb.words(self.data, marks=True)
        if len(begin) != len(terms):
            raise ValueError("terms hold letters, digits and what is not ASCII only")
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def found(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms): which of the words of a text are terms, and of which number."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.searchsorted(self.hashes, hashes)
        near[near == len(self.hashes)] = 0
        at = np.flatnonzero(self.hashes[near] == hashes)
        term = self.order[near[at]]
        size = end[at] - begin[at]
        same = size == self.size[term]
        for n in np.unique(size[same]):
            rows = np.flatnonzero(same & (size == n))
            for part in np.array_split(rows, max(1, len(rows) * int(n) >> 22)):
                offset = np.arange(n)
                same[part] = (tb._LOWER[data[begin[at[part], None] + offset]] == self.data[self.start[term[part], None] + offset]).all(axis=1)
        return at[same], term[same]


def matched(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(key, n, terms, counts) of (key, text): the number of a document's terms, and which of ``terms`` it holds how often."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(terms)
        for whole in batches:
            for batch in tb.pieces(whole, "text"):
                data, starts = tb.joined(batch.column("text"))
                begin, end, hashes = tb.words(data, lower=True, marks=True)
                doc = np.searchsorted(starts, begin, side="right") - 1
                n = np.bincount(doc, minlength=batch.num_rows)
                at, term = known.found(data, begin, end, hashes)
                pairs, counts = np.unique(doc[at] * max(1, len(terms)) + term, return_counts=True)
                owner, term = np.divmod(pairs, max(1, len(terms)))
                offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(t))) for x, t in ((term, np.int32), (counts, np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n.astype(np.int64)), *lists], names=["key", "n", "terms", "counts"]).filter(pa.array(n > 0))

    return docs.select("key", "text").mapInArrow(run, f"key {kind}, n long, terms array<int>, counts array<long>")


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of each range, one after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Block:
    """The posting lists of some documents, and sparse tables of the places of range maxima over them."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, impact: np.ndarray, vocabulary: int):
        self.n = len(offsets) - 1
        order = np.argsort(terms, kind="stable")  # documents ascend within a term
        self.doc = np.repeat(np.arange(self.n), np.diff(offsets))[order]
        self.impact = np.append(impact[order], 0)
        self.first = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        longest = int(np.diff(self.first).max(initial=1))
        # table j has the place of the maximum among 2 ** j postings from each one on; look-ups stay inside one list
        self.tables = [np.arange(len(order), dtype=np.int32)]
        while 2 << (len(self.tables) - 1) <= longest:
            last, step = self.tables[-1], 1 << (len(self.tables) - 1)
            ahead = np.concatenate([last[step:], last[len(last) - step :]])
            self.tables.append(np.where(self.impact[last] >= self.impact[ahead], last, ahead))
        self.tables = np.stack(self.tables)
        self.log = np.zeros(longest + 1, np.int8)
        for j in range(1, len(self.tables)):
            self.log[1 << j :] = j

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores), exact, of all documents that can be among the k best with a score of ``bar`` or more."""
        size = self.first[terms + 1] - self.first[terms]
        terms, times, size = terms[size > 0], times[size > 0, None], size[size > 0]
        none = np.zeros(0, np.int64)
        if not len(terms):
            return none, none
        # place[t, d]: the first posting of list t at document d or behind it
        place = np.zeros((len(terms), self.n + 1), np.int32)
        place[np.repeat(np.arange(len(terms)), size), self.doc[_ranges(self.first[terms], size)] + 1] = 1
        place = np.cumsum(place, axis=1, dtype=np.int32) + self.first[terms].astype(np.int32)[:, None]

        def bounded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Intervals [low, high) with their bounds, and the documents with the largest contributions."""
            a, b = place[:, low], place[:, high]
            some = b > a
            j = self.log[np.where(some, b - a, 1)]
            one, other = self.tables[j, np.where(some, a, 0)], self.tables[j, np.where(some, b - (1 << j.astype(np.int32)), 0)]
            top = np.where(self.impact[one] >= self.impact[other], one, other)
            gain = np.where(some, times * self.impact[top], 0)
            most = gain.argmax(axis=0)
            return low, high, gain.sum(axis=0), self.doc[top[most, np.arange(len(low))]]

        now = bounded(np.zeros(1, np.int64), np.full(1, self.n))
        found, scores, width = [none], [none], 8
        while True:
            now = tuple(x[now[2] >= bar] for x in now)
            if not len(now[0]):
                return np.concatenate(found), np.concatenate(scores)
            chosen = np.zeros(len(now[0]), bool)
            chosen[np.argpartition(-now[2], width)[:width] if len(now[0]) > width else slice(None)] = True
            low, high, _, doc = (x[chosen] for x in now)
            at = place[:, doc]
            score = np.where(place[:, doc + 1] > at, times * self.impact[at], 0).sum(axis=0)
            found.append(doc[score >= bar])
            scores.append(score[score >= bar])
            every = np.concatenate(scores)
            if len(every) >= k:
                bar = max(bar, int(np.partition(every, len(every) - k)[len(every) - k]))
            low, high = np.concatenate([low, doc + 1]), np.concatenate([doc, high])
            some = high > low
            new = bounded(low[some], high[some])
            now = tuple(np.concatenate([x[~chosen], y]) for x, y in zip(now, new, strict=True))
            width = min(2 * width, 512)


def _searched(rows: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, documents: int, n_terms: int, how: Ranking) -> DataFrame:
    """(item, key, score): each span's k best documents for each of the slice's items, by number."""
    kind = rows.schema["key"].dataType.simpleString()
    spans = max(1, -(-documents // (how.block * how.span)))
    dealt = rows.filter("size(terms) > 0").withColumn("span", F.expr(f"cast(pmod(xxhash64(at), {spans}) as int)"))
    dealt = dealt.select("span", "key", "n", "terms", "counts").repartition("span").sortWithinPartitions("span", "key")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            span = batch.column("span").to_numpy()
            # a piece has at most so many postings too, or is one document
            full = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)) // _POSTINGS
            edge = np.append(np.flatnonzero(np.append(True, (span[1:] != span[:-1]) | (full[1:] != full[:-1]))), len(span)) if len(span) else [0]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                for at in range(int(a), int(b), how.block):
                    yield int(span[a]), batch.slice(at, min(how.block, int(b) - at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = []
        kept, span = pa.int64(), None

        def results() -> pa.RecordBatch:
            rows = [(k, key, -score) for k, own in enumerate(best) for score, _, key in own]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), kept, pa.int64()), strict=True)], names=["item", "key", "score"])

        seen = 0
        for now, piece in blocks(batches):
            if now != span:
                if best:
                    yield results()
                span, seen, best = now, 0, [[] for _ in items]
            kept = piece.column("key").type
            lists, counts = (piece.column(c) for c in ("terms", "counts"))
            offsets = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            terms, counts = (x.flatten().to_numpy(zero_copy_only=False) for x in (lists, counts))
            length = np.repeat(piece.column("n").to_numpy(), np.diff(offsets))
            block = Block(offsets, terms, impacts(weight[terms], counts, length, documents, n_terms), len(weight))
            names = piece.column("key")
            for k, (own, times) in enumerate(items):
                bar = max(1, -best[k][-1][0] if len(best[k]) == how.k else 1)
                found, scores = block.search(own, times, how.k, bar)
                if len(found):
                    # equal scores stay in the order of the keys, in which documents come
                    best[k] = heapq.nsmallest(how.k, [*best[k], *((-int(s), seen + int(d), names[int(d)].as_py()) for d, s in zip(found, scores, strict=True))])
            seen += piece.num_rows
        if best:
            yield results()

    return dealt.mapInArrow(run, f"item int, key {kind}, score long")


def _slices(items: DataFrame, how: Ranking) -> Iterator[pa.Table]:
    """(key, terms) of the items, some at a time: about ``slice_terms`` terms, or one larger item."""
    rows = checkpointed(items.withColumn("at", F.monotonically_increasing_id()))
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = max(1, -(-total // how.slice_terms))
    for k in range(n):
        part = rows.filter(f"pmod(xxhash64(at), {n}) = {k}").select("key", "terms").toArrow()
        if part.num_rows:
            yield part


def ranked(items: DataFrame, docs: DataFrame, item_key: str = "item_id", item_text: str = "text", key: str = "doc_id", text: str = "text", how: Ranking | None = None) -> DataFrame:
    """(item_key, rank, key, score): the k best documents of each item, best first."""
    how = how or Ranking()
    asked = items.select(F.col(item_key).alias("key"), F.regexp_extract_all(F.translate(F.col(item_text), _UPPER, _LOWER), F.lit(TERM), F.lit(0)).alias("terms"))
    asked = asked.filter("key is not null and size(terms) > 0")
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null")
    spark, kind = docs.sparkSession, items.schema[item_key].dataType.simpleString()
    out = None
    for part in _slices(asked, how):
        lists = [[t.encode() for t in x] for x in part.column("terms").to_pylist()]
        terms = sorted({t for x in lists for t in x})
        number = {t: k for k, t in enumerate(terms)}
        own = [np.unique(np.array([number[t] for t in x]), return_counts=True) for x in lists]
        rows = checkpointed(matched(source, terms).withColumn("at", F.monotonically_increasing_id()))
        documents, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = {r["term"]: r["df"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for a term of the slice
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(k, 0) + 1))) for k in range(len(terms))], dtype=np.int64)
        found = _searched(rows, own, weight, documents, n_terms, how)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "key"))
        best = found.withColumn("rank", rank).filter(F.col("rank") <= how.k)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(part.num_rows), pa.int32()), "name": part.column("key")}))
        best = best.join(names, "item").select(F.col("name").alias(item_key), "rank", F.col("key").alias(key), "score")
        out = best if out is None else checkpointed(out).union(best)
    return out if out is not None else spark.createDataFrame([], f"`{item_key}` {kind}, rank int, `{key}` {source.schema['key'].dataType.simpleString()}, score long")


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that score highest for each benchmark item."""
    return ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * n_docs) // n_terms) AS m FROM d, c),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""
