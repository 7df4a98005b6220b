"""Token ids of whole batches of texts, for use inside Spark tasks.

For tokenizers that drop white space and never join what it separates, a text's ids are
the ids of its words one after another, so each distinct word is encoded once per worker
process and a batch is put together from the stored ids. The caches are bounded. A word
is known by a 64-bit hash, so among the 1.5 million words that a cache holds at most, two get
each other's ids with a probability of less than 1e-7.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import textbytes as tb

#: Trailing characters that the tokenizer splits from a word's letters anyway.
_TAIL = ".,;:!?"


class BatchTokenizer:
    def __init__(self, path: str, most_words: int = 1_500_000, most_pieces: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        probe = ["ab cd", "ab\ncd", " ab \t cd "]
        plain = self._encode(["ab"])[0] + self._encode(["cd"])[0]
        #: whether words can be encoded one by one
        self.by_word = all(x == plain for x in self._encode(probe))
        self.letters_alone = self.by_word and [x.id for x in self.model.tokenize("abcd")] == self._encode(["abcd"])[0] and self._encode(["Ab,"])[0] == self._encode(["ab"])[0] + self._encode([","])[0]
        self.most_words, self.most_pieces = most_words, most_pieces
        self.pieces: dict[str, list[int]] = {}
        self._forget()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.store = np.empty(0, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32), and where each text's begin (one more at the end). Null: no ids."""
        if not self.by_word:
            found = self._encode([x or "" for x in texts.to_pylist()])
            ends = np.cumsum([0, *map(len, found)])
            return np.array([i for x in found for i in x], dtype=np.int32), ends
        data, starts = tb.joined(texts)
        begin, end, hashes = tb.words(data)
        keys, where, code = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.most_words:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            ids = self._words([raw[begin[i] : end[i]].decode("utf-8", "replace") for i in where[new]])
            size = np.array([len(x) for x in ids], dtype=np.int64)
            at = len(self.store) + np.cumsum(size) - size
            self.store = np.concatenate([self.store, np.array([i for x in ids for i in x], dtype=np.int32)])
            self.keys = np.insert(self.keys, place[new], keys[new])
            self.at = np.insert(self.at, place[new], at)
            self.size = np.insert(self.size, place[new], size)
            place = np.searchsorted(self.keys, keys)
        size = self.size[place][code]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.store[np.repeat(self.at[place][code] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(begin, starts)]

    def _words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word; letters and the marks behind them are looked up apart."""
        if len(self.pieces) > self.most_pieces:
            self.pieces.clear()
        known = self.pieces
        split, missing = [], {}
        for word in words:
            core = word.rstrip(_TAIL) if self.letters_alone else word
            if len(core) == len(word) or not core.isalpha():
                parts = (word,)
            else:
                parts = (core, word[len(core) :])
            if self.letters_alone:
                parts = tuple(p.lower() if p.isascii() else p for p in parts)
            split.append(parts)
            for p in parts:
                if p not in known:
                    missing[p] = None
        rest = []
        for p in missing:
            if self.letters_alone and p.isascii() and p.isalpha():
                known[p] = [x.id for x in self.model.tokenize(p)]
            else:
                rest.append(p)
        for at in range(0, len(rest), 4096):
            known.update(zip(rest[at : at + 4096], self._encode(rest[at : at + 4096]), strict=True))
        return [known[p[0]] if len(p) == 1 else known[p[0]] + known[p[1]] for p in split]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> BatchTokenizer:
    """One tokenizer for each worker process and file."""
    return BatchTokenizer(path)
