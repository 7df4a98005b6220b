"""Training-order materialisation of token sequences (operator 6).

Documents become fixed-length sequences of token ids. A sequence's dense index goes
through a keyed Feistel permutation of [0, n) (cycle-walking brings values of the power of
four above n back into range), which gives it a slot in the training order without a
sort key to store or a shuffle buffer to seed. Range partitions of slots write shards of
fixed-stride records, so slot g is found by division alone and a reader resumes anywhere.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .common import checkpointed, shared_dir, table
from .packing import tokenizer_path
from .tokens import tokenizer


@dataclass(frozen=True)
class Order:
    tokenizer_path: str
    length: int = 2048
    end_id: int = 1
    pad_id: int = 0
    key: int = 20240131
    rounds: int = 6
    shard_bytes: int = 64 << 20


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The image of each of ``index`` (in [0, n)) under the keyed permutation of [0, n)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = tb.spread(key & 0xFFFFFFFF, rounds) ^ np.uint64(key >> 32)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (tb.mix(right + k) & mask)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(index, dtype=np.uint64))
    while (over := out >= np.uint64(n)).any():
        out[over] = once(out[over])
    return out


def slot_of(index: Column, n: int, key: int, rounds: int) -> Column:
    @F.pandas_udf(T.LongType())
    def slot(x: pd.Series) -> pd.Series:
        return pd.Series(feistel(x.to_numpy(), n, key, rounds).astype(np.int64))

    return slot(index)


def sequences(docs: DataFrame, how: Order, text: str = "text") -> DataFrame:
    """(part, number, n_tokens, payload): documents with end ids, cut every ``length`` ids.

    ``payload`` holds zstandard-compressed unsigned 16-bit ids, padded to ``length``.
    Null and empty texts are an end id each. A stream ends with its partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        part = TaskContext.get().partitionId()
        number, held = 0, np.empty(0, np.uint16)

        def cut(ids: np.ndarray, real: int) -> pa.RecordBatch:
            nonlocal number
            rows = ids.reshape(-1, how.length)
            left = np.clip(real - how.length * np.arange(len(rows)), 0, how.length)
            out = [pa.array(np.full(len(rows), part, np.int32)), pa.array(number + np.arange(len(rows))), pa.array(left.astype(np.int32)), pa.array([squeeze(r.tobytes()) for r in rows], pa.binary())]
            number += len(rows)
            return pa.RecordBatch.from_arrays(out, names=["part", "number", "n_tokens", "payload"])

        for whole in batches:
            for batch in tb.pieces(whole, "text"):
                ids, at = tokenizer(how.tokenizer_path).encode(batch.column(0))
                if len(ids) and int(ids.max()) > 0xFFFF:
                    raise ValueError("token ids need more than 16 bits")
                stream = np.insert(ids.astype(np.uint16), at[1:], how.end_id)
                held = np.concatenate([held, stream])
                whole_ids = len(held) // how.length * how.length
                if whole_ids:
                    yield cut(held[:whole_ids], whole_ids)
                    held = held[whole_ids:]
        if len(held):
            yield cut(np.append(held, np.full(-len(held) % how.length, how.pad_id, np.uint16)), len(held))

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "part int, number long, n_tokens int, payload binary")


def _write_shards(rows: DataFrame, folder: str, how: Order, per_shard: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        unpack = zstandard.ZstdDecompressor().decompress
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        out, shard = None, None

        def close() -> None:
            if out is not None:
                out.close()
                # the same rows give the same bytes, so a second attempt may replace the first
                store.move(f"{base}/.{shard}-{attempt}", f"{base}/shard-{shard:08d}.bin")

        for batch in batches:
            sums = []
            for slot, payload in zip(batch.column("slot").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if slot // per_shard != shard:
                    close()
                    shard = slot // per_shard
                    out = store.open_output_stream(f"{base}/.{shard}-{attempt}", compression=None)
                raw = unpack(payload)
                out.write(raw)
                sums.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([batch.column("index"), batch.column("slot"), batch.column("n_tokens"), pa.array(np.array(sums, dtype=np.int64))], names=["index", "slot", "n_tokens", "crc32"])
        close()

    return rows.select("index", "slot", "n_tokens", "payload").mapInArrow(run, "index long, slot long, n_tokens int, crc32 long")


def materialise(docs: DataFrame, folder: str, how: Order, text: str = "text") -> DataFrame:
    """Write the shards to ``folder`` (a URI that all executors reach); one row per sequence.

    Columns: index (in corpus order), slot, shard, byte_offset, n_tokens (without padding)
    and crc32 of the record. Slot s is record s % per_shard of shard s // per_shard, and
    order.json, which tells the sizes, is written when all shards are there, so a folder
    without it is unfinished. A task that is run again writes the same bytes. An empty table
    gives no shard. Only ``text`` is read; repeated rows are sequences of their own.
    """
    cut = checkpointed(sequences(docs, how, text))
    counts = cut.groupBy("part").agg(F.count("*").alias("n"))
    # one row per input partition
    offsets = counts.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    n = cut.count()
    per_shard = max(1, how.shard_bytes // (2 * how.length))
    shards = max(1, -(-n // per_shard))
    # 12 bytes for each input partition; beyond 100,000 of them Spark chooses the join
    rows = cut.join(F.broadcast(offsets) if cut.rdd.getNumPartitions() <= 100_000 else offsets, "part").withColumn("index", F.col("before") + F.col("number"))
    rows = rows.withColumn("slot", slot_of(F.col("index"), max(n, 1), how.key, how.rounds))
    ranged = rows.select("index", "slot", "n_tokens", "payload").repartitionById(shards, F.expr(f"cast(slot div {per_shard} as int)")).sortWithinPartitions("slot")
    done = checkpointed(_write_shards(ranged, folder, how, per_shard))
    _put(folder, "order.json", json.dumps({"sequences": n, "length": how.length, "per_shard": per_shard, "stride": 2 * how.length, "dtype": "<u2", "key": how.key, "rounds": how.rounds}).encode())
    return done.select("index", "slot", F.expr(f"slot div {per_shard}").alias("shard"), (F.col("slot") % per_shard * (2 * how.length)).alias("byte_offset"), F.col("n_tokens").cast("long").alias("n_tokens"), "crc32")


def as_uri(folder: str) -> str:
    """A folder's name with its scheme."""
    return folder if "://" in folder else "file://" + folder.removeprefix("file:")


def _put(folder: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(data)


def read_from(folder: str, slot: int = 0) -> Iterator[np.ndarray]:
    """The sequences of a materialised folder from ``slot`` on, in training order."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{base}/order.json", compression=None) as f:
        order = json.loads(f.read())
    for shard in range(slot // order["per_shard"], -(-order["sequences"] // order["per_shard"])):
        with store.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            f.seek(max(0, slot - shard * order["per_shard"]) * order["stride"])
            while record := f.read(order["stride"]):
                yield np.frombuffer(record, dtype=order["dtype"])


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of 2048 ids, written in training order to the shared folder."""
    return materialise(table(spark, sf_dir, "documents"), f"{as_uri(shared_dir(spark))}/training-order-{uuid.uuid4().hex}", Order(tokenizer_path()))
