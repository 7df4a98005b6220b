"""MinHash near-dedup with tensored banding (operator 9).

Two collections of ``bands`` sub-keys of ``rows`` minhashes each give bands * bands table
keys by pairing, so 2 * bands * rows minhashes do the work of bands * bands * 2 * rows. A
pair of similarity s shares a table with probability (1 - (1 - s^rows)^bands)^2: 0.9996 at
0.8 and 0.99999 at 0.86 with the defaults.

Texts with the same shingle set (by a 128-bit digest of the whole set) are one vertex from the
start. Candidates share a table, and each is verified on the full shingle sets, in two rounds:

1. each vertex against the vertex that is central in most of its tables (central: in
   the largest tables), which settles groups of copies without pairing their members;
2. in tables that still hold several components, the pairs from different ones that pass
   an exact prefix filter (see ``prefix_candidates``). Copies with so many changes of their
   own that they link with nothing have only rare items in their prefix, and meet nobody.

So no link between different components is left out, while pairs inside a component are never
listed. Sets hold 64-bit hashes of shingles.

Null texts and texts without words have no shingle and link with nothing. A row whose key
is null is kept, with a null component. Rows of one key and different texts are judged
by their own texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import checkpointed, release, table
from .graph import components


def _shingles(hashes: np.ndarray, width: int, weights: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's words."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < width:
        return tb.mix(np.array([(hashes * weights[:n]).sum(dtype=np.uint64) + np.uint64(n)], dtype=np.uint64))
    total = hashes[: n - width + 1] * weights[0]
    for i in range(1, width):
        total = total + hashes[i : n - width + 1 + i] * weights[i]
    return np.unique(tb.mix(total))


def _document_sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    weights = tb.spread(3, width) | np.uint64(1)
    data, starts = tb.joined(batch.column("text"))
    begin, _, hashes = tb.words(data, lower=True)
    at = np.searchsorted(begin, starts)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield _shingles(hashes[a:b], width, weights)


def _least(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    if len(found) > 4096:
        return np.min([_least(found[i : i + 4096], factors) for i in range(0, len(found), 4096)], axis=0)
    return np.multiply.outer(factors, found).min(axis=1)


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(key, n_shingles, digest, a, b) of (key, text); the digest names the whole set."""
    key = docs.schema["key"].dataType
    count = 2 * bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = tb.spread(5, count) | np.uint64(1)
        place = tb.spread(7, rows) | np.uint64(1)
        for whole in batches:
            for batch in tb.pieces(whole, "text"):
                n = np.zeros(batch.num_rows, dtype=np.int64)
                least = np.zeros((batch.num_rows, count), dtype=np.uint64)
                digests = []
                for k, found in enumerate(_document_sets(batch, width)):
                    digests.append(blake2b(found.tobytes(), digest_size=16).digest())
                    if len(found):
                        n[k], least[k] = len(found), _least(found, factors)
                sub = tb.mix((least.reshape(-1, 2 * bands, rows) * place).sum(axis=2, dtype=np.uint64)).view(np.int64)
                offsets = np.arange(0, batch.num_rows * bands + 1, bands, dtype=np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x).reshape(-1))) for x in (sub[:, :bands], sub[:, bands:])]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n), pa.array(digests, pa.binary()), *lists], names=["key", "n_shingles", "digest", "a", "b"])

    return docs.select("key", "text").mapInArrow(run, f"key {key.simpleString()}, n_shingles long, digest binary, a array<long>, b array<long>")


#: 64-bit words of a set's parities.
_WORDS = 8
_PARITY = [f"s{k}" for k in range(_WORDS)]


def _parities(found: np.ndarray) -> np.ndarray:
    """For each of 64 * _WORDS classes of items, whether the set holds an odd number of them.

    An item that one of two sets lacks changes one parity, so sets differ in at least as many items as parities.
    """
    odd = np.bincount((tb.mix(found) & np.uint64(64 * _WORDS - 1)).astype(np.int64), minlength=64 * _WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, items, s0, ...): the full shingle set of each text as sorted hashes, and its parities."""
    key = docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.pieces(whole, "text", 1 << 20):
                found = list(_document_sets(batch, width))
                offsets = np.zeros(len(found) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in found], out=offsets[1:])
                items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))
                parities = np.array([_parities(x) for x in found]).reshape(-1, _WORDS).T
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets).astype(np.int64)), items, *(pa.array(np.ascontiguousarray(p)) for p in parities)], names=["id", "n", "items", *_PARITY])

    return docs.mapInArrow(run, f"id {key.simpleString()}, n long, items array<long>, " + ", ".join(f"{s} long" for s in _PARITY))


def _several(rows: DataFrame, group: list[str], what: str) -> DataFrame:
    """The groups that hold more than one value of ``what``."""
    return rows.groupBy(*group).agg(F.min(what).alias("lo"), F.max(what).alias("hi")).filter("lo < hi").select(*group)


def _only(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the given groups. These are written first, so that both sides of the join
    are shuffled for it and Spark can split a group with very many rows."""
    return rows.join(checkpointed(groups), by, "left_semi")


def table_entries(vertices: DataFrame, bands: int) -> DataFrame:
    """(id, n_lo, n_hi, t): the tensored tables that a vertex shares with another one.

    A table key combines a sub-key of the first collection with one of the second. Sub-keys
    that only one vertex has can't be shared and go before they are paired.
    """
    sub = vertices.select("id", "n", F.posexplode(F.concat("a", "b")).alias("i", "x"))
    mine = _only(sub, _several(sub, ["i", "x"], "id"), ["i", "x"]).groupBy("id").agg(F.collect_list(F.struct("i", "x")).alias("own"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"))
    first, second = F.expr(f"filter(own, s -> s.i < {bands})"), F.expr(f"filter(own, s -> s.i >= {bands})")
    paired = mine.select("id", "n_lo", "n_hi", F.explode(first).alias("p"), second.alias("q")).select("id", "n_lo", "n_hi", "p", F.explode("q").alias("q"))
    entries = checkpointed(paired.select("id", "n_lo", "n_hi", F.xxhash64("p.i", "p.x", "q.i", "q.x").alias("t")))
    return checkpointed(_only(entries, _several(entries, ["t"], "id"), ["t"]))


def central_candidates(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b): each vertex with the one that is central in most of its tables."""
    sizes = checkpointed(entries.groupBy("t").agg(F.count("*").alias("c")))
    reach = entries.select("id", "t").join(sizes, "t").groupBy("id").agg(F.sum("c").alias("reach"))
    known = checkpointed(entries.join(reach, "id"))
    centre = checkpointed(known.groupBy("t").agg(F.max(F.struct("reach", "id", "n_lo", "n_hi")).alias("c")))
    beside = known.select("id", "n_lo", "n_hi", "t").join(centre, "t").filter(f"id <> c.id and 100 * n_hi >= {percent} * c.n_lo and 100 * c.n_hi >= {percent} * n_lo")
    often = beside.groupBy("id", F.col("c.id").alias("o")).agg(F.count("*").alias("c"))
    chosen = often.groupBy("id").agg(F.max(F.struct("c", "o")).alias("c"))
    return chosen.select(F.least("id", "c.o").alias("a"), F.greatest("id", "c.o").alias("b")).distinct()


#: Items of a prefix that travel with its entries.
_CARRIED = 64


def _prefixes(sets: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """(id, h, c, n, own, within): the first items of each set, rarest first.

    Items of one set only (there are ``own``) need no row, but count in the ranks of those behind them.
    """
    item = checkpointed(sets.join(component, "id").select("id", "h", "n", "c", F.explode("items").alias("x")))
    often = checkpointed(item.groupBy("x").agg(F.count("*").alias("f")).filter("f > 1"))
    shared = item.join(often, "x").groupBy("id", "h", "n", "c").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("common"))
    shared = shared.withColumn("own", F.col("n") - F.size("common"))
    # a set's partner has at least percent of its items, and all but (100 - percent) of them in common
    within = F.expr(f"slice(common.x, 1, cast(greatest(0, {100 - percent} * n div 100 + 1 - own) as int))")
    return shared.select("id", "h", "c", "n", "own", within.alias("within"))


def prefix_meetings(sets: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that may be links, by an exact prefix filter.

    All sets are ordered in one way, rarest items first. A link has an overlap of
    percent * (sum of sizes) / (100 + percent) at least, so the first item that the two
    have in common can't stand behind more than (size - overlap) others in either. For an item
    of the larger set, its rank so leaves a range of sizes for the smaller one; sizes
    meet in steps of 5 %. Where most entries of an item and step are of one component,
    these are met with the others only. Of the pairs that meet, those whose parities differ
    in more places than the items of a link can are dropped in the join, before any is written.

    A pair is due at the first item that the two have in common. So an entry carries the items before it
    (the prefix's first ``_CARRIED``), and is met by no entry that carries one of these too: it was due there.
    Only pairs whose first common item is behind these are given more than once.
    """
    prefixes = checkpointed(_prefixes(sets, component, percent))
    ranked = prefixes.select("id", "h", "c", "n", "own", F.posexplode("within").alias("k", "x")).select("id", "h", "c", "n", "x", "k", (F.col("own") + F.col("k")).alias("i"))
    step = F.floor(F.log("n") / F.log(F.lit(1.05))).cast("int")
    # the smaller one: overlap >= 2 * percent / (100 + percent) of its size
    small = ranked.filter(f"{100 + percent} * (n - i) >= {2 * percent} * n").withColumn("q", step)
    upto = f"least(n, ({100 + percent} * (n - i)) div {percent} - n)"
    large = ranked.withColumn("most", F.expr(upto)).withColumn("least", F.expr(f"greatest(1, n * {percent} div 100)")).filter("most >= least")
    steps = F.sequence(F.floor(F.log("least") / F.log(F.lit(1.05))).cast("int"), F.floor(F.log("most") / F.log(F.lit(1.05))).cast("int"))
    large = large.select("id", "h", "c", "n", "x", "k", "i", F.explode(steps).alias("q"))
    columns = ["x", "q", "id", "h", "c", "n", "k", "i"]
    entries = checkpointed(small.select(*columns, F.lit(False).alias("is_large")).union(large.select(*columns, F.lit(True))))
    each = entries.groupBy("x", "q", "c").agg(F.count("*").alias("m"), F.max("is_large").alias("l"), F.min("is_large").alias("s"))
    most = each.groupBy("x", "q").agg(F.max(F.struct("m", "c")).alias("top"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("l").alias("l"), F.min("s").alias("s"))
    most = checkpointed(most.filter("lo < hi and l and not s").select("x", "q", F.col("top.c").alias("top")))
    met = entries.join(most, ["x", "q"]).withColumn("is_top", F.col("c") == F.col("top")).drop("top")
    carried = prefixes.select("id", "h", F.slice("within", 1, _CARRIED).alias("within")).join(sets.select("id", "h", *_PARITY), ["id", "h"])
    met = met.join(carried, ["id", "h"]).withColumn("before", F.slice("within", F.lit(1), F.least("k", F.lit(_CARRIED)))).drop("within", "h", "k")
    met = checkpointed(met)
    one, other = met.filter("is_large").drop("is_large"), met.filter("not is_large").drop("is_large").select("x", "q", *[F.col(k).alias(f"o_{k}") for k in ("id", "c", "n", "i", "is_top", "before", *_PARITY)])
    differ = " + ".join(f"bit_count({s} ^ o_{s})" for s in _PARITY)
    fits = F.expr(f"c <> o_c and (n > o_n or n = o_n and id > o_id) and {100 + percent} * least(n - i, o_n - o_i) >= {percent} * (n + o_n) and {100 + percent} * ({differ}) <= {100 - percent} * (n + o_n) and not arrays_overlap(before, o_before)")
    found = [one.filter("not is_top").join(other, ["x", "q"]).filter(fits), one.filter("is_top").join(other.filter("not o_is_top"), ["x", "q"]).filter(fits)]
    found = [f.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")) for f in found]
    return found[0].union(found[1])


def prefix_candidates(sets: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs that meet by their prefixes, once each."""
    return prefix_meetings(sets, component, percent).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, bands: int = 12, rows: int = 3) -> DataFrame:
    """(key, text_hash, n_shingles, component_id, kept), one row per row of ``docs``.

    Links: 100 * intersection >= percent * union of the sets of ``width``-word shingles of
    texts with A-Z lower-cased (with fewer words: all words as one shingle). Rows that
    repeat key and text are one document, so they are kept or not together; other columns
    of ``docs`` are not read. An empty table gives an empty result.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    # the hash travels with the key, so that rows of one key stay apart
    signed = checkpointed(signatures(source.select(F.struct("key", "text_hash").alias("key"), "text"), width, bands, rows)).select(F.col("key.key").alias("key"), F.col("key.text_hash").alias("text_hash"), "n_shingles", "digest", "a", "b")
    vertices = signed.filter("n_shingles > 0 and key is not null").groupBy("n_shingles", "digest").agg(F.min(F.struct("key", "text_hash")).alias("k"), F.first("a").alias("a"), F.first("b").alias("b"))
    vertices = checkpointed(vertices.select(F.col("k.key").alias("id"), F.col("k.text_hash").alias("h"), F.col("n_shingles").alias("n"), "digest", "a", "b"))
    entries = table_entries(vertices, bands)
    texts = vertices.select("id", "h").join(entries.select("id").distinct(), "id", "left_semi")
    found = source.join(texts, (F.col("key") == F.col("id")) & (F.col("text_hash") == F.col("h")), "left_semi").dropDuplicates(["key", "text_hash"])
    sets = checkpointed(shingle_sets(found.select(F.struct("key", "text_hash").alias("id"), "text"), width)).select("id.key", "id.text_hash", "n", "items", *_PARITY).toDF("id", "h", "n", "items", *_PARITY)
    release(docs.sparkSession)

    def links_of(candidates: DataFrame) -> DataFrame:
        """The pairs (a, b) of ``candidates`` that share a table and are links by their full sets.

        An id with several texts may give a pair twice. That is left so: dropping repeats here
        would tie the joins' partitions, and Spark could not split those of a central vertex.
        """
        tables = vertices.select("id", F.col("a").alias("one"), F.col("b").alias("two"))
        keyed = checkpointed(candidates).join(tables.toDF("a", "one_a", "two_a"), "a").join(tables.toDF("b", "one_b", "two_b"), "b")
        meet = F.expr("exists(zip_with(one_a, one_b, (x, y) -> x = y), z -> z) and exists(zip_with(two_a, two_b, (x, y) -> x = y), z -> z)")
        likely = checkpointed(keyed.filter(meet).select("a", "b"))
        full = sets.select("id", "n", "items")
        both = likely.join(full.toDF("a", "n_a", "set_a"), "a").join(full.toDF("b", "n_b", "set_b"), "b")
        shared = F.size(F.array_intersect("set_a", "set_b"))
        return checkpointed(both.filter(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b"))

    links = links_of(central_candidates(entries, percent))
    component = checkpointed(components(links))
    release(docs.sparkSession)
    now = checkpointed(entries.select("id", "t").join(component.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id")))
    mixed = checkpointed(_only(now, _several(now, ["t"], "c"), ["t"]).select("id", "c").distinct())
    links = links.union(links_of(prefix_candidates(sets, mixed, percent)))
    component = checkpointed(components(links))
    release(docs.sparkSession)
    groups = vertices.join(component, "id", "left").select(F.col("n").alias("gn"), F.col("digest").alias("gd"), F.coalesce("component", "id").alias("component"))
    out = signed.select("key", "text_hash", "n_shingles", "digest").join(groups, (F.col("n_shingles") == F.col("gn")) & (F.col("digest") == F.col("gd")), "left")
    component_id = F.when(F.col("key").isNull(), F.lit(None)).otherwise(F.coalesce("component", "key"))
    return out.select(F.col("key").alias(key), "text_hash", "n_shingles", component_id.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents by 4-word shingles at 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept")


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near duplicates stays."""
    gone = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"))
    return docs.join(gone, (F.col("__id") == F.col("doc_id")) & (F.col("__h") == F.xxhash64("text")), "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT documents.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, documents.doc_id = min(r.b) AS kept
FROM documents JOIN r ON r.a = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id GROUP BY documents.doc_id
"""
