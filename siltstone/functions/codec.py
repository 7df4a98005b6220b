"""Trigrams, hashes and posting lists as bytes.

The vectorised functions take whole Arrow batches; ``register`` names them for SQL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOP = (1 << 63) - 1


def packed(data: np.ndarray) -> np.ndarray:
    """All windows of three bytes, the first byte most significant."""
    wide = data.astype(np.int32)
    return (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]


def pack(three: Column) -> Column:
    """One window of three bytes as a number."""
    return F.conv(F.hex(three), 16, 10).cast("int")


def _bytes(value: object) -> bytes:
    return value.encode() if isinstance(value, str) else bytes(value)


def _lists(found: list[np.ndarray | None], kind: pa.DataType) -> pa.ListArray:
    """An Arrow column of numpy arrays, without an object for each of their numbers."""
    sizes = [0 if x is None else len(x) for x in found]
    values = [x for x in found if x is not None]
    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    held = pa.array(np.concatenate(values) if values else np.zeros(0), kind)
    return pa.ListArray.from_arrays(offsets, held, mask=pa.array([x is None for x in found], pa.bool_()))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def trigrams(content: pa.Array) -> pa.Array:
    """Distinct trigrams of a string's or blob's bytes, ascending; null for null."""
    return _lists([np.unique(packed(np.frombuffer(c.as_buffer(), np.uint8))) if c.is_valid else None for c in content], pa.int32())


@F.pandas_udf(T.LongType())
def fnv1a64(content: pd.Series) -> pd.Series:
    """FNV-1a over the bytes as a signed 64-bit number; all rows step byte by byte together."""
    raw = [b"" if c is None else _bytes(c) for c in content]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = (np.cumsum(sizes) - sizes)[order]
    state = np.full(len(raw), 0xCBF29CE484222325, dtype=np.uint64)
    left = sizes[order]
    for k in range(int(sizes.max()) if len(raw) else 0):
        live = int(np.searchsorted(-left, -k, side="left"))
        state[:live] = (state[:live] ^ data[starts[:live] + k]) * np.uint64(0x100000001B3)
    out = np.empty(len(raw), np.uint64)
    out[order] = state
    signed = out.view(np.int64)
    return pd.Series([None if c is None else int(h) for c, h in zip(content, signed, strict=True)], dtype="Int64")


def encode_ids(ids: np.ndarray) -> bytes:
    """LEB128 numbers of the gaps between ascending ids; the first gap is the first id."""
    gaps = np.diff(np.asarray(ids, dtype=np.int64), prepend=np.int64(0)).astype(np.uint64)
    if not len(gaps):
        return b""
    groups = np.stack([(gaps >> np.uint64(7 * k)).astype(np.uint64) for k in range(9)], axis=1)
    size = 1 + (groups[:, 1:] > 0).sum(axis=1)
    low = (groups & np.uint64(0x7F)).astype(np.uint8)
    more = np.arange(9)[None, :] < (size - 1)[:, None]
    taken = np.arange(9)[None, :] < size[:, None]
    out = (low | (more.astype(np.uint8) << 7))[taken]
    return out.tobytes()


def _decoded(data: bytes | pa.Buffer) -> tuple[np.ndarray | None, str | None]:
    """(ids, None), or (None, what is wrong with the first bad number)."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.append(0, ends + 1)
    sizes = np.diff(starts)
    # a number has nine groups of seven bits and one bit more at most, which is beyond 63 bits if it is set
    overlong = (sizes > 10) | ((sizes == 10) & (raw[ends] > 1))
    bad = np.flatnonzero(overlong | ((sizes == 10) & (raw[ends] == 1)))
    n = int(bad[0]) if len(bad) else len(ends)
    upto = int(starts[n])
    group = np.arange(upto) - np.repeat(starts[:n], sizes[:n])
    bits = (raw[:upto] & 0x7F).astype(np.int64) << (7 * group)
    # a sum of two numbers below 2 ** 63 that is too large is negative
    ids = np.cumsum(np.add.reduceat(bits, starts[:n])) if n else np.zeros(0, np.int64)
    if (ids < 0).any():
        return None, "Overflow"
    if len(bad):
        return None, "Overlong" if overlong[n] else "Overflow"
    left = len(raw) - upto
    if left >= 10:
        return None, "Overlong"
    return (None, "Truncated") if left else (ids, None)


def decode_ids(data: bytes) -> tuple[list[int] | None, str | None]:
    """(ids, None), or (None, what is wrong): Truncated, Overlong or Overflow."""
    ids, error = _decoded(data)
    return (None if ids is None else ids.tolist()), error


def encoded_lengths(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of ``encode_ids`` of each list of a column, which holds no nulls inside lists."""
    gaps = np.diff(ids, prepend=ids[:1])
    heads = offsets[:-1][np.diff(offsets) > 0]
    gaps[heads] = ids[heads]
    size = np.ones(len(gaps), np.int64)
    for k in range(1, 9):
        more = gaps >= 1 << (7 * k)
        if not more.any():
            break
        size += more
    size[gaps < 0] = 10
    sums = np.append(0, np.cumsum(size))
    return sums[offsets[1:]] - sums[offsets[:-1]]


@F.pandas_udf(T.BinaryType())
def encode_postings(ids: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else encode_ids(x) for x in ids], dtype=object)


def decoded(data: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(ids, error) of a column of blobs; null for null."""
    found = [_decoded(d.as_buffer()) if d.is_valid else (None, None) for d in data]
    return _lists([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())


@F.arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("error", T.StringType())]))
def decode_postings(data: pa.Array) -> pa.Array:
    """What a blob holds, or why it is damaged; damaged rows do not fail the job."""
    return pa.StructArray.from_arrays(list(decoded(data)), names=["ids", "error"])


def gaps(ids: Column) -> Column:
    """Differences between the ids of an ascending list, the first id first."""
    return F.transform(ids, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get(ids, i - 1)))


@F.arrow_udf(T.LongType())
def encoded_size(ids: pa.Array) -> pa.Array:
    """Bytes of ``encode_postings`` without making them; null for null."""
    values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    return pa.array(encoded_lengths(values, offsets), pa.int64(), mask=ids.is_null().to_numpy(zero_copy_only=False))


def intersected(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def merged(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def merge_changes(a: Column, b: Column) -> Column:
    """Whether ``merged`` holds more than ``a``."""
    return F.size(F.array_union(a, b)) > F.size(a)


def register(spark: SparkSession) -> None:
    """trigrams, fnv1a64, encode_postings and decode_postings for SQL."""
    for name, function in {"trigrams": trigrams, "fnv1a64": fnv1a64, "encode_postings": encode_postings, "decode_postings": decode_postings}.items():
        spark.udf.register(name, function)
