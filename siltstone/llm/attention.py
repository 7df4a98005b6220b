"""Quality classifier by attention-based multiple-instance learning (operator 7).

A document is cut into passages of ``passage_words`` words. Each passage is encoded from
its words, hashed to 4096 learned vectors of which the mean is taken, and from its style (shares
of bytes and words of several kinds, repeats, word lengths); gated attention weighs
the encodings h,

    a = softmax(w . (tanh(V h) * sigmoid(U h))),

and a logistic function of the weighted sum is the score. All weights are learned from
document labels on at most ``most_labelled`` documents, with all their passages, by Adam
with written-out slopes.

Rows with a null key or label don't take part in training; of repeated labels of a key the
largest counts, and every row of ``docs`` with that key is learned from. Labels of one class
only, or none, give scores near that class, or near one half. Every row is scored by its own
text, null keys too.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import table
from .labelled import fitted, held_out, training_rows

_KINDS = [
    np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>@^~_=+\\/{}[]"]),
    np.isin(np.arange(256), [ord(c) for c in ".!?"]),
    np.isin(np.arange(256), [ord(c) for c in ",;:'\"()-"]),
    np.isin(np.arange(256), np.arange(48, 58)),
    np.isin(np.arange(256), np.arange(65, 91)),
    np.arange(256) >= 0xC0,
    np.arange(256) == 10,
]
_STYLE = len(_KINDS) + 7
_WORDS = 1 << 12


@dataclass(frozen=True)
class Attention:
    most_labelled: int = 8000
    passage_words: int = 64
    #: whether passages are encoded from their style too, or from words alone
    style: bool = True
    encoded: int = 24
    gate: int = 12
    epochs: int = 12
    batch: int = 64
    rate: float = 0.005
    decay: float = 1e-4


@dataclass
class Passages:
    """Passages of some texts: style, buckets of all words, and the first word of each passage and one more."""

    style: np.ndarray
    words: np.ndarray
    at: np.ndarray

    def taken(self, a: int, b: int) -> Passages:
        return Passages(self.style[a:b], self.words[self.at[a] : self.at[b]], self.at[a : b + 1] - self.at[a])

    @staticmethod
    def together(parts: list[Passages]) -> Passages:
        ends = np.cumsum([0, *(len(p.words) for p in parts)])
        at = [p.at[:-1] + end for p, end in zip(parts, ends[:-1], strict=True)]
        return Passages(np.concatenate([p.style for p in parts]), np.concatenate([p.words for p in parts]), np.append(np.concatenate(at), ends[-1]))


def _passages(texts: pa.Array, words_each: int) -> tuple[Passages, np.ndarray]:
    """Every passage, and each text's first passage (one more at the end)."""
    data, starts = tb.joined(texts)
    begin, end, hashes = tb.words(data, lower=True)
    at = np.searchsorted(begin, starts)
    counts = -(-np.diff(at) // words_each)
    texts_at = np.concatenate([[0], np.cumsum(counts)])
    n = int(texts_at[-1])
    if not n:
        return Passages(np.zeros((0, _STYLE)), np.empty(0, np.int64), np.zeros(1, np.int64)), texts_at
    own = np.repeat(np.arange(len(counts)), counts)
    first = at[own] + (np.arange(n) - texts_at[own]) * words_each
    last = np.minimum(first + words_each, at[own + 1])
    size = (last - first).astype(np.float64)
    a, b = begin[first], end[last - 1]
    span = np.maximum(b - a, 1).astype(np.float64)
    out = np.zeros((n, _STYLE))
    for k, kind in enumerate(_KINDS):
        sums = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int32)])
        out[:, k] = np.sqrt((sums[b] - sums[a]) / span)
    length = (end - begin).astype(np.float64)
    k = len(_KINDS)
    out[:, k] = np.log1p(size)
    mean = np.add.reduceat(length, first) / size
    out[:, k + 1] = mean
    out[:, k + 2] = np.sqrt(np.maximum(np.add.reduceat(length**2, first) / size - mean**2, 0))
    out[:, k + 3] = np.add.reduceat(length <= 4, first) / size
    same = np.zeros(len(hashes), dtype=bool)
    text = np.repeat(np.arange(len(counts)), np.diff(at))
    for lag in range(1, 9):
        again = np.zeros(len(hashes), dtype=bool)
        again[lag:] = (hashes[lag:] == hashes[:-lag]) & (text[lag:] == text[:-lag])
        if lag == 1:
            out[:, k + 4] = np.add.reduceat(again, first) / size
        same |= again
    out[:, k + 5] = np.add.reduceat(same, first) / size
    mark = _KINDS[0] | _KINDS[1] | _KINDS[2]
    out[:, k + 6] = np.add.reduceat(mark[data[end - 1]], first) / size
    return Passages(out, (hashes % np.uint64(_WORDS)).astype(np.int64), np.append(first, len(hashes))), texts_at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(m: dict[str, np.ndarray], x: Passages, at: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of bags (passages of ``x`` from ``at``), and what the slopes need."""
    size = np.diff(x.at)
    style = (x.style - m["mean"]) / m["spread"]
    h = np.tanh(style @ m["E"] + np.add.reduceat(m["W"][x.words], x.at[:-1], axis=0) / size[:, None] + m["e"])
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    raw = (t * g) @ m["w"]
    starts, counts = at[:-1], np.diff(at)
    raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), counts))
    a = raw / np.repeat(np.add.reduceat(raw, starts), counts)
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"style": style, "size": size, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ m["c"] + m["b"])}


def _slopes(m: dict[str, np.ndarray], x: Passages, at: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """The slope of the mean logistic loss in each learned weight."""
    f, counts = _forward(m, x, at), np.diff(at)
    error = (f["y"] - labels) / len(labels)
    each = np.repeat(error[:, None] * m["c"], counts, axis=0)
    da = (each * f["h"]).sum(axis=1)
    draw = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at[:-1]), counts))
    dt, dg = draw[:, None] * m["w"] * f["g"] * (1 - f["t"] ** 2), draw[:, None] * m["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * each + dt @ m["V"].T + dg @ m["U"].T
    dpre = dh * (1 - f["h"] ** 2)
    per_word = np.repeat(dpre / f["size"][:, None], f["size"], axis=0)
    return {
        "E": f["style"].T @ dpre, "e": dpre.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
        "W": np.stack([np.bincount(x.words, per_word[:, k], len(m["W"])) for k in range(m["W"].shape[1])], axis=1),
        "w": (draw[:, None] * f["t"] * f["g"]).sum(axis=0), "c": f["z"].T @ error, "b": np.array([error.sum()]),
    }


def fit_attention(bags: list[tuple[Passages, int]], how: Attention) -> dict[str, np.ndarray]:
    """Weights from (passages, label) of documents."""
    chance = np.random.default_rng(3)
    bags = [(x, y) for x, y in bags if len(x.style)]
    every = np.concatenate([x.style for x, _ in bags]) if bags else np.zeros((1, _STYLE))
    share = sum(y for _, y in bags) / len(bags) if bags else 0.5
    share = min(max(share, 0.01), 0.99)
    m = {
        "mean": every.mean(axis=0), "spread": every.std(axis=0) + 0.02,
        "E": chance.normal(size=(_STYLE, how.encoded)) / np.sqrt(_STYLE) * how.style, "W": chance.normal(size=(_WORDS, how.encoded)) * 0.1, "e": np.zeros(how.encoded),
        "V": chance.normal(size=(how.encoded, how.gate)) / np.sqrt(how.encoded), "U": chance.normal(size=(how.encoded, how.gate)) / np.sqrt(how.encoded),
        "w": np.zeros(how.gate), "c": np.zeros(how.encoded), "b": np.array([np.log(share / (1 - share))]),
    }
    learned = ["E", "W", "e", "V", "U", "w", "c", "b"][0 if how.style else 1 :]
    m["w"] += chance.normal(size=how.gate) * 0.1
    m["c"] += chance.normal(size=how.encoded) * 0.1
    mean, square = ({k: np.zeros_like(m[k]) for k in learned} for _ in range(2))
    step = 0
    for _ in range(how.epochs):
        order = chance.permutation(len(bags))
        for cut in range(0, len(order), how.batch):
            some = [bags[k] for k in order[cut : cut + how.batch]]
            at = np.cumsum([0, *(len(x.style) for x, _ in some)])
            slope = _slopes(m, Passages.together([x for x, _ in some]), at, np.array([y for _, y in some]))
            step += 1
            for k in learned:
                s = slope[k] + how.decay * m[k]
                mean[k] = 0.9 * mean[k] + 0.1 * s
                square[k] = 0.999 * square[k] + 0.001 * s**2
                m[k] = m[k] - how.rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    m["none"] = np.array([share])
    return m


def train(docs: DataFrame, labels: DataFrame, how: Attention | None = None, label: str = "quality", key: str = "doc_id", text: str = "text") -> bytes:
    """A model from document labels; without labelled documents all scores are near one half."""
    how = how or Attention()

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.pieces(whole, "text"):
                x, at = _passages(batch.column("text"), how.passage_words)
                own = [x.taken(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
                columns = [[p.style.astype(np.float32).tobytes() for p in own], [p.words.astype(np.uint16).tobytes() for p in own]]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.binary()) for c in columns], batch.column("label")], names=["style", "words", "label"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for style, words, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = np.frombuffer(words, np.uint16).astype(np.int64)
                style = np.frombuffer(style, np.float32).reshape(-1, _STYLE).astype(np.float64)
                at = np.minimum(np.arange(len(style) + 1) * how.passage_words, len(words))
                found.append((Passages(style, words, at), label))
        out = io.BytesIO()
        model = fit_attention(found, how)
        np.savez(out, **(model | {"W": model["W"].astype(np.float32)}))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    rows = training_rows(docs, labels, label, key, text, how.most_labelled)
    return fitted(rows.mapInArrow(bags, "style binary, words binary, label int"), fit)


def score(docs: DataFrame, model: bytes, how: Attention | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, passage, attention) for every row of ``docs``.

    ``passage`` is the one with most attention, from 0. A text without words (null, empty)
    scores as the share of label 1 in training, with null passage and attention.
    """
    how = how or Attention()
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # less than 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = dict(np.load(io.BytesIO(shared.value)))
        for whole in batches:
            for batch in tb.pieces(whole, "text"):
                x, at = _passages(batch.column("text"), how.passage_words)
                some = np.flatnonzero(np.diff(at))
                value = np.full(batch.num_rows, m["none"][0])
                best, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                if len(some):
                    bounds = np.append(at[some], at[-1])
                    f = _forward(m, x, bounds)
                    value[some] = f["y"]
                    top = np.array([f["a"][a:b].argmax() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
                    best[some], weight[some] = top, f["a"][bounds[:-1] + top]
                none = np.diff(at) == 0
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(value), pa.array(best, mask=none), pa.array(weight, mask=none)], names=["key", "score", "passage", "attention"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double, passage long, attention double")
    return out.withColumnRenamed("key", key)


def op7_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "passage", "attention")
