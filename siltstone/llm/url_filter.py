"""URL filter over a sorted digest array (operator 3).

A list of rules (host, path, verdict) of any length becomes shards of one sorted array: Spark
range-partitions entries by the 64-bit xxhash of their string, and each partition writes its
keys, strings and values to a file in the shared folder. A rule is an entry (host, NUL, path) with its
verdict, and each host with rules an entry of its own with the lengths of its paths. The driver
gets one row a shard.

Tasks gather up to ``_HELD`` rows, and look up the digests of all suffixes of their hosts' labels; a
suffix that is a rule's host gives as many digests more as that host has lengths of paths, and no
URL is tried with other hosts' lengths. Digests are sent through vectorised binary search shard by shard, so
a shard is memory-mapped (where the shared folder is not a mounted one, read through
``pyarrow.fs``) once for all held rows. A hit counts only if the stored string equals the
probe's. The longest matching rule decides (at equal length the one with the longer host), and URLs
without one get the default verdict. The shards are deleted once the verdicts are written.

A null URL or one without ``://`` has an empty host and path and matches no rule. Rules
with a null or empty host or a null path are ignored; a path that is not empty and does not
start with ``/`` matches nothing; of equal rules a block wins. An empty list of rules
gives every URL the default.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, shared_dir, table
from .materialise import as_uri

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, _URL, 1), _UPPER, _LOWER), F.regexp_extract(whole, _URL, 2)


def _digest(text: Column) -> Column:
    return F.xxhash64(text)


def _digests(texts: list[bytes]) -> np.ndarray:
    """What ``_digest`` gives, inside tasks."""
    return np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], dtype=np.uint64).view(np.int64)


def _entries(rules: DataFrame) -> DataFrame:
    """(text, value): for each rule its host, NUL and path with its verdict, for each host the lengths of its paths."""
    own = rules.select(F.concat("host", F.lit("\0"), "path").alias("text"), F.array(F.when(F.col("blocked"), 1).otherwise(0)).alias("value"))
    hosts = rules.groupBy("host").agg(F.sort_array(F.collect_set(F.length("path"))).alias("value")).select(F.col("host").alias("text"), "value")
    return own.union(hosts)


def write_array(rules: DataFrame, folder: str) -> tuple[list[int], list[str]]:
    """Write the entries of (host, path, blocked) as shards: each shard's least key, and the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        keys, values = rows.column("digest").to_numpy(), rows.column("value").chunk(0)
        strings = [t.encode() for t in rows.column("text").to_pylist()]
        ends = [np.cumsum(x, dtype=np.int64) for x in ([len(t) for t in strings], values.value_lengths().to_numpy(zero_copy_only=False))]
        parts = [np.array([len(keys), ends[1][-1]], np.int64), keys, *ends, values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)]
        name = f"shard-{uuid.uuid4().hex}.bin"  # a second attempt writes its own
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(b"".join(x.tobytes() for x in parts) + b"".join(strings))
        yield pa.RecordBatch.from_arrays([pa.array([int(keys[0])]), pa.array([f"{folder}/{name}"])], names=["least", "file"])

    ordered = _entries(rules).withColumn("digest", _digest(F.col("text"))).repartitionByRange("digest").sortWithinPartitions("digest")
    shards = sorted(ordered.mapInArrow(run, "least long, file string").collect())
    return [s["least"] for s in shards], [s["file"] for s in shards]


class Shard:
    """One part of the array: sorted keys, and behind them the ends of strings and values, values and strings."""

    def __init__(self, file: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(file)
        if isinstance(store, fs.LocalFileSystem):
            data = np.memmap(path, dtype=np.uint8, mode="r")
        else:
            with store.open_input_file(path) as f:
                data = np.frombuffer(f.read(), dtype=np.uint8)
        n, m = data[:16].view(np.int64).tolist()
        numbers = data[16 : 16 + 8 * (3 * n + m)].view(np.int64)
        self.keys, self.ends, self.upto, self.values = numbers[:n], numbers[n : 2 * n], numbers[2 * n : 3 * n], numbers[3 * n :]
        self.strings = data[16 + 8 * (3 * n + m) :]

    def string(self, at: int) -> bytes:
        return self.strings[int(self.ends[at - 1]) if at else 0 : int(self.ends[at])].tobytes()

    def value(self, at: int) -> list[int]:
        return self.values[int(self.upto[at - 1]) if at else 0 : int(self.upto[at])].tolist()


#: Rows that a task gathers before it goes through the shards.
_HELD = 100_000


def _found(texts: list[bytes], least: np.ndarray, files: list[str]) -> dict[bytes, list[int]]:
    """The values of those of some different texts that are entries; each shard is opened once at most."""
    if not texts or not files:
        return {}
    digests, out = _digests(texts), {}
    # equal digests lie in one shard, as ranges are cut between different digests
    of = np.searchsorted(least, digests, side="right") - 1
    order = np.argsort(of, kind="stable")
    edge = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))
    for own in np.split(order, edge[1:]):
        if of[own[0]] < 0:
            continue
        shard = Shard(files[int(of[own[0]])])
        first, last = (np.searchsorted(shard.keys, digests[own], side=side) for side in ("left", "right"))
        for j in np.flatnonzero(first < last).tolist():
            text = texts[int(own[j])]
            for place in range(int(first[j]), int(last[j])):
                if shard.string(place) == text:
                    out[text] = shard.value(place)
    return out


def _verdicts(urls: list[tuple[str, str]], least: np.ndarray, files: list[str], default: str) -> list[tuple[str | None, str]]:
    """(rule, verdict) of each (host, path)."""
    suffixes = {}
    for host in {h for h, _ in urls if h}:
        labels = host.split(".")
        suffixes[host] = [".".join(labels[k:]) for k in range(len(labels))]
    hosts = _found(list({s.encode() for own in suffixes.values() for s in own if s}), least, files)
    asked = []
    for host, path in urls:
        # the longest rule first, and of equally long ones that of the longer host
        fitting = [(len(s.encode()) + len(path[:n].encode()), len(s.encode()), s, path[:n]) for s in suffixes.get(host, ()) for n in hosts.get(s.encode(), ()) if n <= len(path)]
        asked.append([(s, p) for _, _, s, p in sorted(fitting, reverse=True)])
    rules = _found(list({f"{s}\0{p}".encode() for own in asked for s, p in own}), least, files)
    out = []
    for own in asked:
        hit = next(((s + p, rules[k]) for s, p in own if (k := f"{s}\0{p}".encode()) in rules), None)
        out.append((None, default) if hit is None else (hit[0], "block" if hit[1][0] else "allow"))
    return out


def _judged(batches: Iterator[pa.RecordBatch], least: np.ndarray, files: list[str], default: str) -> Iterator[pa.RecordBatch]:
    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[tuple[str, str], int] = {}
        own = [[place.setdefault(x, len(place)) for x in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)] for b in held]
        verdicts = _verdicts(list(place), least, files, default)
        for batch, urls in zip(held, own, strict=True):
            rule, verdict = ([verdicts[u][k] for u in urls] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "host", "path")), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["key", "host", "path", "rule", "verdict"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _HELD:
            yield from done(held)
            held = []
    yield from done(held)


def judge_urls(rows: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict), one row per row of ``rows``; other columns are not read.

    ``rules`` has host, path and verdict (block, else allow); hosts are lower-cased.
    """
    spark = rows.sparkSession
    known = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").filter("host <> '' and (path = '' or startswith(path, '/'))")
    known = known.groupBy("host", "path").agg(F.coalesce(F.max(F.col("verdict") == "block"), F.lit(False)).alias("blocked"))
    folder = f"{as_uri(shared_dir(spark))}/url-rules-{uuid.uuid4().hex}"
    starts, files = write_array(known, folder)
    least = np.array(starts, dtype=np.int64)
    kind = rows.schema[key].dataType.simpleString()
    host, path = host_and_path(F.col(url))
    urls = rows.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    out = checkpointed(urls.mapInArrow(lambda batches: _judged(batches, least, files, default), f"key {kind}, host string, path string, rule string, verdict string"))
    if files:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.delete_dir(base)
    return out.withColumnRenamed("key", key)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


ORACLE = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM u),
r(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY strlen(rh || rp) DESC, strlen(rh) DESC) AS k
      FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM h LEFT JOIN m ON m.page_id = h.page_id AND k = 1
"""
