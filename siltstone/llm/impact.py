"""Exact top-k search by inner product over an impact-ordered index (operator 11).

Vectors become whole numbers, floor(scale * x). Rows and queries are dealt out in blocks: a task has
some queries and a span of rows, which it indexes and searches ``block`` rows at a time.

* Index of a block: the rows of one dimension whose values are of one level, by powers of four, are a
  segment. A level's segments are kept as one matrix, a column for each dimension.
* Score at a time: all segments of one level are processed together, for many queries at once, from
  the highest level down: each row sums what it has met.
* After each level a row has an upper bound: its sum, and the product of the query's length with that of
  the row's values below the level. The k-th best exact score so far (of earlier blocks, or of the k
  rows with the largest sums) is the bar. Rows that can't reach it are proved out. Once few
  are left, or no lower level is, the rest is scored exactly.
* The bar goes on from block to block within a task; the k best of each task meet in a window.

So results are exact; the bar only saves work. Equal scores go to the smaller key.

Rows whose key or vector is null, or whose vector holds a null or a non-finite component, or one
that is beyond 2 ** 20 after scaling, take no part; vectors of different lengths don't meet. A query
never meets rows with its own key. Repeated rows are rows of their own, as queries and as results.
No rows or no queries give no result. Only the key and the vector are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Values of one level differ by this factor at most, but for the highest level, which has all above; queries whose sums are held together.
_BASE, _ABREAST = 4, 128


@dataclass(frozen=True)
class Search:
    k: int = 20
    scale: int = 64
    #: Rows that are indexed together, blocks that a task searches one after another, and its queries.
    block: int = 4096
    span: int = 8
    queries: int = 512
    #: The share of a block (1 / rest) that may be left to score exactly when levels stop.
    rest: int = 4


class Segments:
    """A block's rows by levels of their values, from the highest down."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.bound = max(1, int(np.abs(values).max(initial=0)))
        self._levels: dict[type, list[tuple[np.ndarray, np.ndarray]]] = {}

    def kind(self, asked: np.ndarray) -> type:
        """Single precision where that holds all whole numbers on the way."""
        return np.float32 if self.bound * int(np.abs(asked).max(initial=0)) * asked.shape[1] < 1 << 24 else np.float64

    def levels(self, kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
        """(segments, left): a level's segments as one matrix, and the lengths of the rows' lower values."""
        if kind not in self._levels:
            size, floor, out = np.abs(self.values), 1, []
            while _BASE * _BASE * floor <= self.bound:
                floor *= _BASE
            above = self.bound + 1
            while floor:
                lower = np.where(size < floor, self.values, 0).astype(np.float64)
                out.append((np.where((size >= floor) & (size < above), self.values, 0).astype(kind), np.sqrt((lower * lower).sum(axis=1))))
                above, floor = floor, floor // _BASE
            self._levels[kind] = out
        return self._levels[kind]

    def scores(self, rows: np.ndarray, asked: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of a row and a query."""
        parts = [np.einsum("ij,ij->i", self.values[rows[k : k + 8192]], asked[queries[k : k + 8192]]) for k in range(0, len(rows), 8192)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def possible_pairs(index: Segments, asked: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int, bars: np.ndarray, rest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, queries, scores): all pairs of a block that can be among the k best of their query, with exact scores.

    ``own`` pairs are barred; ``bars`` has what a query's rows must reach, minus infinity if that isn't known.
    """
    n, m, kind = len(index.values), len(asked), index.kind(asked)
    turned, bars = np.ascontiguousarray(asked.T).astype(kind), bars.astype(np.float64)
    length = np.sqrt((asked.astype(np.float64) ** 2).sum(axis=1))
    slack = 1 + 1e-6 * index.bound * float(np.abs(asked).max(initial=0)) * asked.shape[1]
    sums, left = np.zeros((n, m), kind), np.ones((n, m), bool)
    for level, (segments, lower) in enumerate(index.levels(kind)):
        sums += segments @ turned
        if not level:
            # the k rows with the largest sums so far: their k-th exact score is met by k rows
            sums[own] = -np.inf
            fresh = np.flatnonzero(np.isneginf(bars) & (n - np.bincount(own[1], minlength=m) >= k))
            if len(fresh):
                likely = np.argpartition(-sums[:, fresh], k - 1, axis=0)[:k].ravel() if n > k else np.repeat(np.arange(n), len(fresh))
                bars[fresh] = index.scores(likely, asked, np.tile(fresh, k)).reshape(k, -1).min(axis=0)
        left = sums >= (bars - slack - np.multiply.outer(lower * (1 + 1e-6), length)).astype(kind)
        if np.count_nonzero(left) * rest <= n * m:
            break
    left[own] = False
    rows, queries = np.nonzero(left)
    scores = index.scores(rows, asked, queries)
    able = scores >= bars[queries]
    return rows[able], queries[able], scores[able]


def possible_rows(index: Segments, q: np.ndarray, own: list[int], k: int, bar: int | None, rest: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores): all rows of a block that can be among the k best of one query; ``own`` rows are barred."""
    barred = np.array(own, dtype=np.int64)
    rows, _, scores = possible_pairs(index, q[None], (barred, np.zeros_like(barred)), k, np.array([-np.inf if bar is None else bar]), rest)
    return rows, scores


def _tasks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(task, piece): a sorted stream cut where task or role change, and at ``block`` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(c).to_numpy() for c in ("d", "span", "part", "role")], axis=1)
        edge = np.append(np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(axis=1))), batch.num_rows)
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            for at in range(int(a), int(b), block):
                yield tuple(names[a].tolist()), batch.slice(at, min(block, int(b) - at))


def top_k(queries: DataFrame, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", how: Search | None = None) -> DataFrame:
    """(query_id, rank, <key>, score): the k rows with the largest inner products for each query.

    ``queries`` and ``rows`` have the key and the vector; keys of both have one type.
    """
    how = how or Search()
    whole = F.transform(F.col("vec"), lambda x: F.floor(x.cast("double") * how.scale))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * how.scale) < float(1 << 20)))

    def usable(frame: DataFrame) -> DataFrame:
        some = frame.select(F.col(key).alias("key"), F.col(vector).alias("vec")).filter(F.col("key").isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size("vec") > 0))
        return checkpointed(some.select("key", whole.cast("array<int>").alias("vec"), F.size("vec").alias("d"), F.monotonically_increasing_id().alias("at")))

    asked, held = usable(queries), usable(rows)
    parts, spans = (max(1, -(-x.count() // most)) for x, most in ((asked, how.queries), (held, how.block * how.span)))
    dealt = asked.withColumn("part", F.expr(f"pmod(xxhash64(at), {parts})")).withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1)))).withColumn("role", F.lit(0))
    met = held.withColumn("span", F.expr(f"pmod(xxhash64(at), {spans})")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("role", F.lit(1))
    columns = ["d", F.col("span").cast("int"), F.col("part").cast("int"), "role", "at", "key", "vec"]
    tasks = dealt.select(*columns).unionByName(met.select(*columns)).repartition("d", "span", "part").sortWithinPartitions("d", "span", "part", "role")
    kind = held.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, searched, own, best, asking = None, None, None, None, []

        def results() -> pa.RecordBatch:
            found = [(at, name, key, -score) for at, name, near in zip(own, searched, best or [], strict=True) for score, key in near] if best else []
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = [pa.int64(), keys_type, keys_type, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["at", "query_id", "key", "score"])

        keys_type = pa.int64()
        for (*now, role), piece in _tasks(batches, how.block):
            keys_type = piece.column("key").type
            if now != task:
                if best:
                    yield results()
                task, searched, own, best, asking = now, [], [], [], []
            values = piece.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(piece.num_rows, -1)
            names = piece.column("key").to_pylist()
            if role == 0:
                searched += names
                own += piece.column("at").to_pylist()
                asking += list(values)
                best += [[] for _ in names]
                continue
            index, sought = Segments(values), {}
            for k, name in enumerate(searched):
                sought.setdefault(name, []).append(k)
            barred = [(row, k) for row, name in enumerate(names) for k in sought.get(name, ())]
            barred = np.array(barred, dtype=np.int64).reshape(-1, 2)
            for first in range(0, len(searched), _ABREAST):
                some = np.array(asking[first : first + _ABREAST])
                bars = np.array([-near[-1][0] if len(near) == how.k else -np.inf for near in best[first : first + _ABREAST]])
                own_here = barred[(barred[:, 1] >= first) & (barred[:, 1] < first + _ABREAST)]
                near, asker, scores = possible_pairs(index, some, (own_here[:, 0], own_here[:, 1] - first), how.k, bars, how.rest)
                order = np.argsort(asker, kind="stable")
                edge = np.searchsorted(asker[order], np.arange(len(some) + 1))
                for k in np.flatnonzero(np.diff(edge)).tolist():
                    at = order[edge[k] : edge[k + 1]]
                    if len(at) > how.k:
                        at = at[scores[at] >= np.partition(scores[at], -how.k)[-how.k]]
                    best[first + k] = heapq.nsmallest(how.k, [*best[first + k], *((-s, names[r]) for r, s in zip(near[at].tolist(), scores[at].tolist(), strict=True))])
        if best:
            yield results()

    found = tasks.mapInArrow(run, f"at long, query_id {kind}, key {kind}, score long")
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= how.k).select("query_id", "rank", F.col("key").alias(key), "score")


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 embeddings with the largest whole-number inner products, for each row whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.filter("vec_id % 20 = 0"), rows)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
