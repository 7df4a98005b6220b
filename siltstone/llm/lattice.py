"""Embedding near-dedup by lattice hashing (operator 10).

In each of ``tables`` tables, random projections take a unit vector to ``blocks`` points of
eight dimensions, and each point is decoded to the nearest point of the E8 lattice. The
vector is filed under its own cell and, one block at a time, under the ``probes`` next
cells around (among the 240 shortest lattice steps). Vectors that share a cell are
candidates, and candidates are verified by cosine in double precision.

With the defaults, a pair shares a cell with probability 0.994 at cosine 0.9 and more than
0.99999 at 0.95; unrelated vectors meet in about 1 of 3000 table cells at cosine 0.3.

Large cells are cut into blocks of at most ``block`` vectors and compared block by block,
as matrix products; a task gives the links' components within its block pair, never the
pairs. Links are then counted inside each component, again block by block and each pair
once, so a count costs one product per pair of a component's vectors.

Vectors that are null, empty, zero or hold a null or a non-finite component link with
nothing, and so do rows with a null key; vectors of different lengths don't link. Equal
vectors are one vertex with a size. Rows of one key and different vectors are each judged by their
own vector; a component is named by the smallest key in it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import checkpointed, table
from .graph import components


@dataclass(frozen=True)
class Lattice:
    at_least: float = 0.9
    tables: int = 24
    blocks: int = 2
    probes: int = 4
    scale: float = 0.7
    seed: int = 1
    block: int = 2048


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with integer coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    odd = (near.sum(axis=-1).astype(np.int64) & 1) == 1
    worst = np.abs(off).argmax(axis=-1)[..., None]
    step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0) * odd[..., None]
    np.put_along_axis(near, worst, np.take_along_axis(near, worst, -1) + step, -1)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 (D8 and D8 shifted by one half) to each row."""
    whole, half = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=-1) <= ((x - half) ** 2).sum(axis=-1)
    return np.where(closer[..., None], whole, half)


@lru_cache
def shortest_steps() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            step = np.zeros(8)
            step[i], step[j] = a, b
            pairs.append(step)
    halves = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(v < 0 for v in s) % 2 == 0]
    return np.concatenate([np.array(pairs), np.array(halves)])


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cells(unit: np.ndarray, how: Lattice) -> np.ndarray:
    """(rows, keys): the 64-bit keys of the cells each unit vector is filed under."""
    steps = shortest_steps()
    weights = tb.spread(19, 8) | np.uint64(1)
    out = []

    def named(points: np.ndarray) -> np.ndarray:
        return tb.mix(((2 * points).astype(np.int64).view(np.uint64) * weights).sum(axis=-1, dtype=np.uint64))

    for t in range(how.tables):
        chance = np.random.default_rng([how.seed, t, unit.shape[1]])
        own, around = [], []
        for _ in range(how.blocks):
            point = unit @ chance.normal(size=(unit.shape[1], 8)) * how.scale
            cell = decode_e8(point)
            own.append(named(cell))
            # |point - cell - step|^2 without the parts that are the same for all steps
            gain = (point - cell) @ steps.T - (steps**2).sum(axis=1) / 2
            best = np.argpartition(-gain, how.probes, axis=1)[:, : how.probes]
            around.append(named(cell[:, None] + steps[best]))
        for block in range(-1, how.blocks):
            key = np.full((len(unit), 1 if block < 0 else how.probes), t, dtype=np.uint64)
            for b in range(how.blocks):
                key = tb.mix(key * np.uint64(0x9E3779B97F4A7C15) + (around[b] if b == block else own[b][:, None]))
            out.append(key)
    return np.concatenate(out, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls whose lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _filed(vertices: DataFrame, how: Lattice) -> DataFrame:
    kind = vertices.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lengths = batch.column("vec").value_lengths().to_numpy(zero_copy_only=False)
                for length in np.unique(lengths):
                    rows = pa.array(np.flatnonzero(lengths == length))
                    # a vector may come to one cell by several ways
                    keys = np.sort(cells(_unit(_matrix(batch.column("vec").take(rows))), how), axis=1)
                    new = np.append(np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1], axis=1)
                    own = rows.take(pa.array(np.nonzero(new)[0]))
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(own), pa.array(keys[new].view(np.int64))], names=["id", "cell"])

    return vertices.select("id", "vec").mapInArrow(run, f"id {kind}, cell long")


def _whole_tasks(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.Table]:
    """A stream sorted by task as tables of about so many rows, or of one larger task."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if count >= rows:
            # up to the last change of task, what is held is whole
            whole = pa.Table.from_batches(held).combine_chunks()
            tasks = np.append(whole.column("task").to_numpy(), batch.column("task")[0].as_py())
            edge = int(np.flatnonzero(np.append(True, tasks[1:] != tasks[:-1]))[-1])
            if edge:
                yield whole.slice(0, edge)
                held = whole.slice(edge).to_batches()
                count -= edge
        held.append(batch)
        count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _block_pairs(members: DataFrame, group: str, vertices: DataFrame, block: int) -> DataFrame:
    """Members (group, id) of each pair of blocks of a group, next to one another: (task, own, id, size, vec)."""
    sizes = members.groupBy(group).agg(F.count("*").alias("n")).filter("n > 1").withColumn("b", F.ceil(F.col("n") / block).cast("int"))
    dealt = members.join(sizes, group).withColumn("own", F.expr("pmod(xxhash64(id, 17), b)").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, b - 1)")))
    dealt = dealt.select("id", F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")).alias("task"), "own", (F.col("own") == F.col("other")).alias("same"))
    return dealt.join(vertices, "id").repartition("task").sortWithinPartitions("task")


#: Tasks of one block of so many vectors at most are compared pair by pair, all of a table at once.
_SMALL = 64
_PAIRS = 1 << 16


def _pairs_of_small(unit: np.ndarray, size: np.ndarray, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links among consecutive groups of ``size`` rows each."""
    n = len(unit)
    after = np.repeat(np.cumsum(size), size) - np.arange(n) - 1  # rows behind a row in its group
    starts = np.cumsum(after) - after
    one = np.repeat(np.arange(n), after)
    other = one + 1 + np.arange(len(one)) - np.repeat(starts, after)
    kept = [np.einsum("ij,ij->i", unit[one[k : k + _PAIRS]], unit[other[k : k + _PAIRS]]) >= at_least for k in range(0, len(one), _PAIRS)]
    kept = np.concatenate(kept) if kept else np.zeros(0, bool)
    return one[kept], other[kept]


def _links(batches: Iterator[pa.RecordBatch], how: Lattice) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, i, j): the links between rows i and j, each once: of one block of a group, or across its two."""
    for tasks in _whole_tasks(batches):
        lengths = tasks.column("vec").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        for length in np.unique(lengths):
            rows = tasks.take(pa.array(np.flatnonzero(lengths == length))).combine_chunks()
            task = rows.column("task").to_numpy()
            first = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            size = np.diff(np.append(first, len(task)))
            same = rows.column("same").to_numpy(zero_copy_only=False)[first]
            small = same & (size <= _SMALL)
            few = rows.take(pa.array(np.flatnonzero(np.repeat(small, size)))).combine_chunks()
            if few.num_rows:
                yield few, *_pairs_of_small(_unit(_matrix(few.column("vec").combine_chunks())), size[small], how.at_least)
            for k in np.flatnonzero(~small):
                own = rows.slice(int(first[k]), int(size[k])).combine_chunks()
                unit = _unit(_matrix(own.column("vec").combine_chunks()))
                block = own.column("own").to_numpy()
                one = np.arange(len(block)) if same[k] else np.flatnonzero(block == block[0])
                other = one if same[k] else np.flatnonzero(block != block[0])
                linked = unit[one] @ unit[other].T >= how.at_least
                i, j = np.nonzero(np.triu(linked, 1) if same[k] else linked)
                yield own, one[i], other[j]


def _star_links(tasks: DataFrame, how: Lattice) -> DataFrame:
    """(a, b): each vector of a task with the first one that it reaches there."""
    kind = tasks.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, i, j in _links(batches, how):
            label = np.arange(rows.num_rows)
            while True:
                new = label.copy()
                np.minimum.at(new, i, label[j])
                np.minimum.at(new, j, label[i])
                new = new[new]
                if (new == label).all():
                    break
                label = new
            far = np.flatnonzero(label != np.arange(len(label)))
            ids = rows.column("id").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(label[far])), ids.take(pa.array(far))], names=["a", "b"])

    return tasks.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _link_counts(tasks: DataFrame, how: Lattice) -> DataFrame:
    kind = tasks.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, i, j in _links(batches, how):
            size = rows.column("size").to_numpy()
            n = np.bincount(i, size[j], len(size)) + np.bincount(j, size[i], len(size))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([rows.column("id").combine_chunks().take(pa.array(some)), pa.array(n[some].astype(np.int64))], names=["id", "n"])

    return tasks.mapInArrow(run, f"id {kind}, n long").groupBy("id").agg(F.sum("n").alias("n"))


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", how: Lattice | None = None) -> DataFrame:
    """(key, n_links, component_id, kept), one row per row of ``rows``; other columns are not read."""
    how = how or Lattice()
    usable = F.col("key").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    source = rows.select(F.col(key).alias("key"), F.col(vector).alias("vec"))
    source = source.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))
    # a vertex has a number of its own, as one key may come with several vectors
    vertices = source.filter("ok").groupBy("h1", "h2").agg(F.min("key").alias("least"), F.count("*").alias("size"), F.first("vec").alias("vec"))
    vertices = checkpointed(vertices.withColumn("id", F.monotonically_increasing_id()))
    body = vertices.select("id", "size", "vec")
    # written once: both sides of a join are made of it
    filed = checkpointed(_filed(vertices, how))
    links = _star_links(_block_pairs(filed, "cell", body, how.block), how)
    component = checkpointed(components(checkpointed(links)))
    counts = _link_counts(_block_pairs(component, "component", body, how.block), how)
    names = component.join(vertices.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("name"))
    known = vertices.select("h1", "h2", "id", "size", "least").join(component.join(counts, "id", "left").join(names, "component"), "id", "left")
    known = known.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("name", "least").alias("component"))
    out = source.drop("vec").join(known, (F.col("ok")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component_id = F.coalesce("component", "key")
    return out.select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("key") == component_id, F.lit(True)).alias("kept"))


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings at cosine 0.9."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
ok AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(max(n.n), 0)::BIGINT AS n_links, min(r.b) AS component_id, vec_id = min(r.b) AS kept
FROM embeddings JOIN r ON r.a = vec_id LEFT JOIN n ON n.a = vec_id GROUP BY vec_id
"""
