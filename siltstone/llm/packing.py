"""Order-preserving packing of documents into fixed windows (operator 1).

The token stream of a partition is cut into windows of at most ``window`` tokens. Cuts may
fall at the end of a document (free), at the end of a sentence (costs ``sentence_cost``)
or, where neither is near, anywhere (costs ``free_cost``). Dynamic programming finds the
cuts that minimise padding plus costs:

    best(j) = cost(j) + min over i >= j - window of best(i) + padding(j - i)

Padding is window - (j - i), so the minimum over i is that of best(i) + i over a sliding
window, which a monotone queue gives in constant time. Windows whose length is a power of
two need no padding and are a handful of further transitions.

Documents keep their order and stay within their partition. The stream is packed in
stretches of about ``stretch`` tokens, so memory does not grow with the partition, and a
document longer than that spans stretches.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import table
from .tokens import tokenizer


@dataclass(frozen=True)
class Packing:
    tokenizer_path: str
    window: int = 2048
    end_id: int = 1
    sentence_cost: int = 12
    free_cost: int = 96
    #: a free cut is offered this often where there is no other
    free_every: int = 256
    stretch: int = 1 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_windows(candidates: np.ndarray, costs: np.ndarray, window: int) -> list[int]:
    """Window ends with least padding plus costs; the last candidate is the stream's end.

    ``candidates`` are increasing positions above 0, no two more than ``window`` apart.
    """
    place = candidates.tolist()
    cost = costs.tolist()
    powers = [1 << k for k in range(window.bit_length() - 1, 5, -1) if 1 << k <= window]
    best = {0: 0}
    before = {}
    queue: deque = deque([(0, 0)])
    for p, c in zip(place, cost, strict=True):
        low = p - window
        while queue[0][1] < low:
            queue.popleft()
        value, start = queue[0]
        value += window - p
        for n in powers:
            other = best.get(p - n)
            if other is not None and other < value:
                value, start = other, p - n
        value += c
        best[p] = value
        before[p] = start
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p))
    cuts = []
    p = place[-1]
    while p:
        cuts.append(p)
        p = before[p]
    return cuts[::-1]


def _candidates(total: int, ends: np.ndarray, sentences: np.ndarray, how: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and what that costs."""
    cost = np.full(total + 1, -1, dtype=np.int32)
    cost[sentences] = how.sentence_cost
    tail = total - (1 << np.arange(how.window.bit_length()))
    tail = tail[tail > 0]
    cost[tail] = np.where(cost[tail] < 0, how.free_cost, cost[tail])
    cost[ends] = 0
    cost[total] = 0
    found = np.flatnonzero(cost >= 0)
    found = found[found > 0]
    gaps = np.diff(found, prepend=0)
    wide = np.flatnonzero(gaps > how.free_every)
    more = [np.arange(found[k] - gaps[k] + how.free_every, found[k], how.free_every) for k in wide]
    if more:
        more = np.concatenate(more)
        cost[more] = how.free_cost
        found = np.flatnonzero(cost >= 0)
        found = found[found > 0]
    return found, cost[found]


def _sentence_ends(path: str) -> np.ndarray:
    """Ids of tokens that end a sentence: a word-final run of marks with . ! or ?"""
    vocabulary = tokenizer(path).tokenizer.get_vocab()
    return np.array(sorted(i for t, i in vocabulary.items() if t.endswith("</w>") and t[:-4] and set(t[:-4]) <= set(".!?\"')]") and set(t[:-4]) & set(".!?")), dtype=np.int32)


def pack(docs: DataFrame, how: Packing, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences, one row per piece.

    Columns: key, start (the document's ids before it), length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit numbers), doc_tokens (with the end id), sequence_id,
    offset, and with ``with_ids`` the ids themselves as such bytes. A null or empty text
    is its end id alone. Every row of ``docs`` is packed, repeated rows too; keys may be
    null. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends_sentence = np.zeros(1 << 20, dtype=bool)
        ends_sentence[_sentence_ends(how.tokenizer_path)] = True
        next_sequence = TaskContext.get().partitionId() << 33
        held: list = []  # (key, ids, start, doc_tokens)
        size = 0

        def packed() -> pa.RecordBatch:
            nonlocal next_sequence
            ids = np.concatenate([x[1] for x in held]) if held else np.empty(0, np.int32)
            bounds = np.cumsum([len(x[1]) for x in held])
            places, costs = _candidates(len(ids), bounds, np.flatnonzero(ends_sentence[ids]) + 1, how)
            cuts = np.array(cut_windows(places, costs, how.window), dtype=np.int64)
            edges = np.union1d(bounds, cuts)
            starts = np.concatenate([[0], edges[:-1]])
            doc = np.searchsorted(bounds, starts, side="right")
            sequence = np.searchsorted(cuts, starts, side="right")
            doc_start = np.concatenate([[0], bounds[:-1]])
            first = np.array([x[2] for x in held], dtype=np.int64)
            wide = memoryview(ids.astype("<u4").tobytes())
            parts = [wide[4 * a : 4 * b] for a, b in zip(starts, edges, strict=True)]
            columns = [
                pa.array([held[d][0] for d in doc], type=pa_key),
                pa.array(starts - doc_start[doc] + first[doc]),
                pa.array(edges - starts),
                pa.array(np.array([zlib.crc32(x) for x in parts], dtype=np.int64)),
                pa.array(np.array([x[3] for x in held], dtype=np.int64)[doc]),
                pa.array(next_sequence + sequence),
                pa.array(starts - np.concatenate([[0], cuts])[sequence]),
            ] + ([pa.array([x.tobytes() for x in parts], pa.binary())] if with_ids else [])
            next_sequence += len(cuts)
            return pa.RecordBatch.from_arrays(columns, names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + (["ids"] if with_ids else []))

        pa_key = pa.int64()
        for whole in batches:
            pa_key = whole.schema.field(0).type
            for batch in tb.pieces(whole, "__text"):
                ids, at = tokenizer(how.tokenizer_path).encode(batch.column(1))
                for k, name in enumerate(batch.column(0).to_pylist()):
                    own = np.append(ids[at[k] : at[k + 1]], np.int32(how.end_id))
                    for start in range(0, len(own), how.stretch):
                        held.append((name, own[start : start + how.stretch], start, len(own)))
                        size += len(held[-1][1])
                        if size >= how.stretch:
                            yield packed()
                            held, size = [], 0
        if held:
            yield packed()

    return docs.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), Packing(tokenizer_path()))


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: what is left, packed into windows of 2048 tokens."""
    return pack(docs, Packing(tokenizer_path()))
