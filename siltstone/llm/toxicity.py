"""Toxicity by multiple-instance learning (operator 5).

A document is a bag of sentences. A sentence's probability is a logistic function of its
words; a document is toxic if any sentence is: 1 - product of (1 - p), the noisy-or.
Weights are trained from document labels alone through the noisy-or, and the sentence
probabilities then say where the offence is.

A word gives its hash and those of its stems (its first bytes) as features. Only features
in at least ``min_documents`` of the training documents, and in toxic ones more often than
chance by ``min_z`` standard deviations, get a weight. Training sees at most
``most_labelled`` documents, the model has 2^20 weights whatever the corpus.

Rows with a null key or label don't take part in training; of repeated labels of a key the
largest counts, and every row of ``docs`` with that key is learned from. Labels of one class
only, or none, leave every weight at zero, and all texts unlikely to offend. Every row is
scored by its own text, null keys too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import table
from .labelled import fitted, held_out, training_rows

_BUCKETS = 1 << 20
_STEMS = (5, 6, 7)
_PER_WORD = 1 + len(_STEMS)
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


@dataclass(frozen=True)
class Toxicity:
    most_labelled: int = 8000
    min_documents: int = 6
    min_z: float = 5.0
    epochs: int = 40
    batch: int = 256
    rate: float = 0.05
    decay: float = 1e-5
    bias: float = -6.0


def _sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word features (several a word), each sentence's first of them, each text's first sentence, and sentences' first and last bytes."""
    data, starts = tb.joined(texts)
    begin, end, hashes = tb.words(data, lower=True, marks=True)
    # a sentence goes on until a full stop, mark or line feed; line feeds also part the texts
    number = np.cumsum(_ENDS[data])[begin] if len(begin) else np.empty(0, np.int64)
    first = np.flatnonzero(np.diff(number, prepend=-1))
    texts_at = np.searchsorted(begin[first], starts)
    last = np.append(first[1:], len(begin))[: len(first)] - 1
    own = np.searchsorted(starts, begin[first], side="right") - 1
    features = np.stack([hashes, *(tb.prefixes(data, begin, end, n) for n in _STEMS)], axis=1).reshape(-1)
    return (features >> np.uint64(44)).astype(np.int32), first * _PER_WORD, texts_at, begin[first] - starts[own], end[last] - starts[own]


def _probabilities(words: np.ndarray, first: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    if not len(first):
        return np.empty(0)
    return 1 / (1 + np.exp(-np.clip(np.add.reduceat(weights[words], first) + bias, -30, 30)))


def fit_noisy_or(bags: list[tuple[np.ndarray, np.ndarray, int]], how: Toxicity) -> bytes:
    """Weights (float32) and bias from (word buckets, first word of each sentence, label)."""
    bags = [b for b in bags if len(b[1])]
    seen, toxic = np.zeros(_BUCKETS, np.int32), np.zeros(_BUCKETS, np.int32)
    for words, _, label in bags:
        own = np.unique(words)
        seen[own] += 1
        toxic[own] += label
    share = sum(label for *_, label in bags) / max(1, len(bags))
    surplus = (toxic - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    chosen = np.flatnonzero((seen >= how.min_documents) & (surplus >= how.min_z))
    weight = np.zeros(_BUCKETS + 1, np.float32)
    weight[-1] = how.bias
    if not len(chosen):
        return weight.tobytes()
    # from here on a feature is its place among the chosen; place 0 is for all others
    place = np.zeros(_BUCKETS, np.int64)
    place[chosen] = np.arange(1, len(chosen) + 1)
    bags = [(place[words], first, label) for words, first, label in bags]
    value = np.zeros(len(chosen) + 2)
    value[-1] = how.bias
    mean, square = np.zeros_like(value), np.zeros_like(value)
    chance = np.random.default_rng(5)
    step = 0
    for _ in range(how.epochs):
        order = chance.permutation(len(bags))
        for at in range(0, len(order), how.batch):
            some = [bags[k] for k in order[at : at + how.batch]]
            sizes = np.array([len(b[0]) for b in some])
            offsets = np.cumsum(sizes) - sizes
            words = np.concatenate([b[0] for b in some])
            first = np.concatenate([b[1] + o for b, o in zip(some, offsets, strict=True)])
            counts = np.array([len(b[1]) for b in some])
            bag_at = np.cumsum(counts) - counts
            label = np.array([b[2] for b in some])
            p = _probabilities(words, first, value[:-1], value[-1])
            none = np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), bag_at))
            pull = np.where(label == 1, -none / np.maximum(1 - none, 1e-9), 1.0)
            by_sentence = p * np.repeat(pull, counts) / len(some)
            by_word = np.repeat(by_sentence, np.diff(np.append(first, len(words))))
            slope = np.append(np.bincount(words, by_word, len(chosen) + 1), by_sentence.sum())
            slope[0] = 0
            slope[:-1] += how.decay * value[:-1]
            step += 1
            mean = 0.9 * mean + 0.1 * slope
            square = 0.999 * square + 0.001 * slope**2
            value -= how.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weight[chosen], weight[-1] = value[1:-1], value[-1]
    return weight.tobytes()


def train(docs: DataFrame, labels: DataFrame, how: Toxicity | None = None, label: str = "toxic", key: str = "doc_id", text: str = "text") -> bytes:
    """A model from document labels; without labelled documents every sentence is unlikely to offend."""
    how = how or Toxicity()

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.pieces(whole, "text"):
                words, first, at, _, _ = _sentences(batch.column("text"))
                bounds = np.append(first, len(words))
                rows = [(words[bounds[a] : bounds[b]].tobytes(), (first[a:b] - bounds[a]).astype(np.int32).tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), batch.column("label")], names=["words", "first", "label"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.frombuffer(w, np.int32), np.frombuffer(f, np.int32), y) for b in batches for w, f, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([fit_noisy_or(found, how)], pa.binary())], names=["model"])

    rows = training_rows(docs, labels, label, key, text, how.most_labelled)
    return fitted(rows.mapInArrow(bags, "words binary, first binary, label int"), fit)


def score(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, worst_sentence, worst_start, worst_end) for every row of ``docs``.

    The sentence counts from 0; its place is in bytes of the UTF-8 text. A text without
    words (null, empty) scores as one sentence without words and has null places.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.frombuffer(shared.value, np.float32).astype(np.float64)
        for whole in batches:
            for batch in tb.pieces(whole, "text"):
                words, first, at, start, end = _sentences(batch.column("text"))
                p = _probabilities(words, first, value[:-1], value[-1])
                sums = np.concatenate([[0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)))])
                some = at[1:] > at[:-1]
                empty = 1 / (1 + np.exp(-value[-1]))
                total = np.where(some, -np.expm1(sums[at[1:]] - sums[at[:-1]]), empty)
                worst = np.array([a + p[a:b].argmax() if b > a else 0 for a, b in zip(at[:-1], at[1:], strict=True)], dtype=np.int64)
                place = worst if len(p) else np.zeros(0, np.int64)
                columns = [(worst - at[:-1]), start[place] if len(p) else worst, end[place] if len(p) else worst]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.clip(total, 0, 1)), *[pa.array(c.astype(np.int64), mask=~some) for c in columns]], names=["key", "score", "worst_sentence", "worst_start", "worst_end"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double, worst_sentence long, worst_start long, worst_end long")
    return out.withColumnRenamed("key", key)


def offending_sentences(docs: DataFrame, model: bytes, at_least: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence, start, end, score) of each sentence that alone reaches ``at_least``; bytes of UTF-8."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.frombuffer(shared.value, np.float32).astype(np.float64)
        for whole in batches:
            for batch in tb.pieces(whole, "text"):
                words, first, at, start, end = _sentences(batch.column("text"))
                p = _probabilities(words, first, value[:-1], value[-1])
                bad = np.flatnonzero(p >= at_least)
                own = np.searchsorted(at, bad, side="right") - 1
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(own)), pa.array(bad - at[own]), pa.array(start[bad]), pa.array(end[bad]), pa.array(p[bad])], names=["key", "sentence", "start", "end", "score"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, sentence long, start long, end long, score double")
    return out.withColumnRenamed("key", key)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_sentence", "worst_start", "worst_end")
