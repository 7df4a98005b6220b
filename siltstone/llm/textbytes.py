"""Word hashes of whole batches of texts with numpy, for use inside Spark tasks.

A word is a run of bytes other than space and 0x09-0x0D; on UTF-8 that is the same as on
code points. Hashes are polynomials over the bytes, taken from running sums, so the
work is a few array passes over a batch and no Python per word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: All ASCII that is no letter or digit, for words without marks.
_IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * _P)


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def powers(p: np.uint64) -> np.ndarray:
        out = np.full(_BLOCK, p, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return spread(11, 256), powers(_P), powers(_P_INVERSE)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a line feed after each text, and where each text starts (one more at the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    parts = [b"" if x is None else x for x in texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in parts], out=starts[1:])
    parts.append(b"")
    return np.frombuffer(b"\n".join(parts), dtype=np.uint8), starts


def words(data: np.ndarray, lower: bool = False, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word of ``data``, which must end with a space character.

    With ``marks``, all ASCII other than letters and digits separates words.
    """
    between = _IS_MARK if marks else _IS_SPACE
    found, at = [], 0
    while at < len(data):
        upto = min(at + _BLOCK, len(data))
        if upto < len(data):
            spaces = np.flatnonzero(between[data[at:upto]])
            upto = at + int(spaces[-1]) + 1 if len(spaces) else upto
            while not between[data[upto - 1]]:  # a word longer than a block
                more = np.flatnonzero(between[data[upto : upto + _BLOCK]])
                upto = upto + int(more[0]) + 1 if len(more) else min(upto + _BLOCK, len(data))
        found.append((at, *_words(data[at:upto], lower, between)))
        at = upto
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate([a + s for a, s, _, _ in found]), np.concatenate([a + e for a, _, e, _ in found]), np.concatenate([h for *_, h in found])


def _words(block: np.ndarray, lower: bool, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, up, down = _tables()
    space = between[block]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.empty(0, np.uint64)
    if len(block) > len(up):
        return start, end, np.array([_long_word(block[a:b], lower) for a, b in zip(start, end, strict=True)], dtype=np.uint64)
    sums = np.zeros(len(block) + 1, dtype=np.uint64)
    np.cumsum(values[_LOWER[block] if lower else block] * up[: len(block)], out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _long_word(word: np.ndarray, lower: bool) -> int:
    """The same polynomial for a word in a block of more than _BLOCK bytes."""
    values, up, _ = _tables()
    total, scale = 0, 1
    for at in range(0, len(word), _BLOCK):
        part = word[at : at + _BLOCK]
        total += scale * int((values[_LOWER[part] if lower else part] * up[: len(part)]).sum(dtype=np.uint64))
        scale = scale * pow(int(_P), _BLOCK, 1 << 64) % (1 << 64)
    return int(mix(np.array([(total + len(word)) % (1 << 64)], dtype=np.uint64))[0])


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of a batch whose texts have at most ``most`` bytes together (or one row)."""
    texts = batch.column(column)
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in texts], dtype=np.int64)
    group = np.cumsum(sizes) // most
    cut = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def prefixes(data: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the first ``length`` bytes (A-Z lower-cased) of each word; of all of a shorter word."""
    values, _, _ = _tables()
    out = np.full(len(start), np.uint64(length), dtype=np.uint64)
    for k in range(length):
        inside = start + k < end
        byte = values[_LOWER[data[np.where(inside, start + k, start)]]]
        out = np.where(inside, (out + byte) * _P, out)
    return mix(out)
