"""Periodic runs of words, found on a grammar of each text (operator 13).

A run is a stretch of words with smallest period q, at least ``times`` periods and ``least``
words long, that no neighbouring word extends keeping that period. Per text, inside the tasks
that read it and without a shuffle:

1. Every three words in a row inside a run occur three times in the text, so only stretches of such
   words can hold runs; most texts have none, which hashes of a batch's words tell. In the others
   words become ids, compared as they are, and stretches are put one after another, each before an
   id of its own that occurs once.
2. Re-Pair: the most frequent pair of neighbouring symbols becomes a nonterminal, until no pair
   occurs twice. What is left of the sequence is paired up evenly, so every boundary
   between two words belongs to one nonterminal.
3. Each nonterminal's runs across its boundary are computed once, at its first place: a run has two
   periods on one side of the boundary, so candidate periods repeat the symbols next to it, and
   are extended both ways inside the nonterminal's expansion.
4. These are translated to all places of the nonterminal in the text, and merged: intervals
   of one period that overlap by a period or more are one run. A run lies whole in the lowest
   nonterminal that spans it, and crosses its boundary, so none is missed.

Null and empty texts have no words and no runs. Rows with null keys and repeated rows are rows
like others; only the key and the text are read. A text is held by one task, with its ids and grammar
(about 500 bytes a word where runs are possible).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import WORD, table

#: Of a run of four periods and six words, each of its 3-grams (2-grams of its cycle and more) occurs three times.
_GRAM, _OFTEN = 3, 3
_SHIFT = 32


def _stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the longest stretches in which every 3-gram occurs three times in the text."""
    if len(ids) < 6:
        return []
    count = int(ids.max()) + 1
    grams = (ids[:-2] * count + ids[1:-1]) * count + ids[2:]  # where this overflows, grams at worst fall together
    _, which, often = np.unique(grams, return_inverse=True, return_counts=True)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], often[which] >= _OFTEN, [False]]).astype(np.int8)))
    return [(int(a), int(b) + _GRAM - 1) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a + _GRAM - 1 >= 6]


def _suspects(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The texts of a batch that have such a stretch, by hashes of their words: no other text has a run."""
    if len(hashes) < 6:
        return doc[:0]
    factor = tb.spread(13, _GRAM + 1) | np.uint64(1)
    grams = tb.mix(hashes[:-2] * factor[0] + hashes[1:-1] * factor[1] + hashes[2:] * factor[2] + doc[2:].astype(np.uint64) * factor[3])
    inside = doc[:-2] == doc[2:]
    ordered = np.sort(grams[inside])
    often = np.unique(ordered[: 1 - _OFTEN][ordered[: 1 - _OFTEN] == ordered[_OFTEN - 1 :]]) if len(ordered) >= _OFTEN else ordered[:0]
    if not len(often):
        return doc[:0]
    near = np.searchsorted(often, grams)
    near[near == len(often)] = 0
    frequent = inside & (often[near] == grams)
    return np.unique(doc[:-5][frequent[:-3] & frequent[1:-2] & frequent[2:-1] & frequent[3:]])


def grammar(ids: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    """Re-Pair: (start symbols, rules); symbol ``max(ids) + 1 + r`` stands for rule r, a pair of earlier symbols."""
    seq, n, base = ids.tolist(), len(ids), int(ids.max()) + 1
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    keys = (ids[:-1] << _SHIFT) + ids[1:]
    order = np.argsort(keys, kind="stable")
    edge = np.flatnonzero(np.diff(keys[order], prepend=-1))
    sizes = np.diff(np.append(edge, len(order)))
    twice = sizes > 1
    # pairs that occur once never occur twice: new neighbours always have a new symbol
    places = {int(keys[order[a]]): order[a : a + m].tolist() for a, m in zip(edge[twice], sizes[twice], strict=True)}
    count = {key: len(at) for key, at in places.items()}
    heap = [(-m, places[key][0], key) for key, m in count.items()]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    serial = n
    while heap:
        m, age, key = heapq.heappop(heap)
        now = count.get(key, 0)
        if now != -m:
            if now > 1:
                heapq.heappush(heap, (-now, age, key))
            continue
        a, b = key >> _SHIFT, key & ((1 << _SHIFT) - 1)
        new, made = base + len(rules), []
        for i in sorted(places.pop(key)):
            j = after[i]
            if seq[i] != a or j >= n or seq[j] != b:
                continue
            left, right = before[i], after[j]
            if left >= 0:
                old = (seq[left] << _SHIFT) + a
                if old in count:
                    count[old] -= 1
                made.append(((seq[left] << _SHIFT) + new, left))
            if right < n:
                old = (b << _SHIFT) + seq[right]
                if old in count:
                    count[old] -= 1
                made.append(((new << _SHIFT) + seq[right], i))
                before[right] = i
            seq[i], seq[j], after[i] = new, -1, right
        count.pop(key)
        rules.append((a, b))
        fresh = {}
        for pair, i in made:
            # a neighbour that was replaced after this pair was noted has another symbol now
            j = after[i]
            if seq[i] == pair >> _SHIFT and j < n and seq[j] == pair & ((1 << _SHIFT) - 1):
                fresh.setdefault(pair, {})[i] = None
        for pair, at in fresh.items():
            if len(at) > 1:
                places[pair], count[pair] = list(at), len(at)
                heapq.heappush(heap, (-len(at), serial, pair))
                serial += 1
    return [x for x in seq if x >= 0], rules


def _agree(x: np.ndarray, i: int, j: int, stop: int) -> int:
    """How many of x[i], x[i + 1], ... equal x[j], x[j + 1], ... below ``stop``; i < j."""
    n, step = 0, 16
    while j + n < stop:
        m = min(step, stop - j - n)
        same = x[i + n : i + n + m] == x[j + n : j + n + m]
        if not same.all():
            return n + int(same.argmin())
        n, step = n + m, 2 * step
    return n


def _crossing(x: np.ndarray, back: np.ndarray, start: int, middle: int, stop: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, stop, period) of runs in x[start:stop] with two periods on one side of ``middle``; ``back`` is x reversed."""
    n, most = len(x), (stop - start) // times
    found: list[tuple[int, int, int]] = []
    upto = min(most, (stop - middle) // 2)
    periods = np.flatnonzero(x[middle + 1 : middle + 1 + upto] == x[middle]) + 1
    for p in periods[x[middle + periods - 1] == x[middle + 2 * periods - 1]].tolist() if len(periods) else ():
        if any(p % q == 0 and a <= middle and b >= middle + 2 * p for a, b, q in found):
            continue  # its smallest period is q
        ahead = _agree(x, middle, middle + p, stop)
        if ahead >= p:
            behind = _agree(back, n - middle - p, n - middle, n - start)
            if ahead + behind + p >= max(least, times * p):
                found.append((middle - behind, middle + p + ahead, p))
    upto = min(most, (middle - start) // 2)
    periods = np.flatnonzero(back[n - middle + 1 : n - middle + 1 + upto] == x[middle - 1]) + 1
    for p in periods[x[middle - periods] == x[middle - 2 * periods]].tolist() if len(periods) else ():
        if any(p % q == 0 and a <= middle - 2 * p and b >= middle for a, b, q in found):
            continue
        behind = _agree(back, n - middle, n - middle + p, n - start)
        if behind >= p:
            ahead = _agree(x, middle - p, middle, stop)
            if ahead + behind + p >= max(least, times * p):
                found.append((middle - p - behind, middle + ahead, p))
    return found


def _merged(found: list[np.ndarray]) -> np.ndarray:
    """(runs, 3): start, stop, period of intervals (start, stop, period), those of one run united; by start, then period."""
    every = np.unique(np.concatenate(found), axis=0)
    every = every[np.lexsort((every[:, 0], every[:, 2]))]
    start, stop, period = every.T
    # stops so far within a period: periods ascend, so stops shifted by them do too
    far = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + period * far) - period * far
    new = np.append(True, (period[1:] != period[:-1]) | (start[1:] + period[1:] > reach[:-1]))
    edge = np.flatnonzero(new)
    out = np.stack([start[edge], np.maximum.reduceat(stop, edge), period[edge]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of(ids: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """(runs, 3): start, length, period of every run of a sequence of word ids below 2 ** 31."""
    none = np.zeros((0, 3), np.int64)
    parts = _stretches(ids)
    if not parts:
        return none
    # between stretches stand ids that occur once, so no pair or run spans two of them
    lone = int(ids.max()) + 1
    x = np.concatenate([np.append(ids[a:b], lone + k) for k, (a, b) in enumerate(parts)])
    origin = np.concatenate([np.append(np.arange(a, b), -1) for a, b in parts])
    level, rules = grammar(x)
    base = int(x.max()) + 1
    while len(level) > 1:
        paired = range(base + len(rules), base + len(rules) + len(level) // 2)
        rules.extend(zip(level[::2], level[1::2]))
        level = [*paired, *level[len(level) & ~1 :]]
    size = [1] * base
    for a, b in rules:
        size.append(size[a] + size[b])
    back = x[::-1].copy()
    places: dict[int, list[np.ndarray]] = {level[0]: [np.zeros(1, np.int64)]}
    found = []
    for symbol in range(base + len(rules) - 1, base - 1, -1):
        if symbol not in places:
            continue
        at = places.pop(symbol)
        at = at[0] if len(at) == 1 else np.concatenate(at)
        a, b = rules[symbol - base]
        first = int(at[0])
        for start, stop, period in _crossing(x, back, first, first + size[a], first + size[symbol], least, times):
            found.append(np.stack([at + (start - first), at + (stop - first), np.full(len(at), period)], axis=1))
        for child, shift in ((a, 0), (b, size[a])):
            if child >= base and size[child] >= least:
                places.setdefault(child, []).append(at + shift if shift else at)
    if not found:
        return none
    out = _merged(found)
    return np.stack([origin[out[:, 0]], out[:, 1] - out[:, 0], out[:, 2]], axis=1)


def _dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words lies in a run, behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """(key, n_words, runs, collapsed), one row per row of ``docs``.

    ``runs`` are (start, length, period) in words, by start and then period; ``collapsed`` is the text's
    words joined by one space, without those that any run holds behind its first period. ``times``
    is 4 at least, ``least`` 6 at least: the search for stretches rests on that. Other columns are not read.
    """
    if times < 4 or least < 6:
        raise ValueError("runs of fewer than four periods or six words are not searched")
    kind = docs.schema[key].dataType.simpleString()
    fields = ["start", "length", "period"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.pieces(whole, "text"):
                offsets, every, texts = [0], [np.zeros((0, 3), np.int64)], []
                data, starts = tb.joined(batch.column("text"))
                begin, _, hashes = tb.words(data)
                doc = np.searchsorted(starts, begin, side="right") - 1
                suspects = set(_suspects(doc, hashes).tolist())
                for k, value in enumerate(batch.column("text")):
                    # on ASCII white space, as bytes; UTF-8 has none of it inside a character
                    words = value.as_buffer().to_pybytes().split() if value.is_valid else []
                    if k in suspects:
                        number: dict[bytes, int] = {}
                        runs = runs_of(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64), least, times)
                        if len(runs):
                            words = [words[i] for i in np.flatnonzero(~_dropped(len(words), runs)).tolist()]
                            every.append(runs)
                            offsets.append(offsets[-1] + len(runs))
                    if len(offsets) == k + 1:
                        offsets.append(offsets[-1])
                    texts.append(b" ".join(words))
                counts = np.bincount(doc, minlength=batch.num_rows)
                table = np.concatenate(every)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], fields))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(counts.astype(np.int64)), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["key", "n_words", "runs", "collapsed"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("key", key)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which are made periodic first, with digests of all runs and of what is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = F.regexp_extract_all("text", F.lit(WORD + "+"), F.lit(0))
    # only a tenth of the rows is split here
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    docs = docs.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    looped = F.expr("array_join(transform(sequence(0L, n - 1L), i -> get(words, cast(if(i < a, i, a + (i - a) % p) as int))), ' ')")
    docs = docs.select("doc_id", F.when(F.col("n") > 0, looped).otherwise(F.col("text")).alias("text"))
    found = periodic_runs(docs)
    # runs come in order, so the first of the greatest stays
    best = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (x, r) -> if(x is null or r.length * x.period > x.length * r.period, r, x))")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
