"""Word hashes and shingles of whole texts, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over all output bits (wrapping arithmetic)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Chunk of bytes -> 64-bit hash as bytes; cleared at a fixed number of entries. ``normal`` maps a chunk to the bytes that count, or None."""

    def __init__(self, normal=None, entries: int = 500_000):
        super().__init__()
        self.normal, self.entries = normal, entries

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.entries:
            self.clear()
        got = self[chunk] = xxhash.xxh3_64_digest(self.normal(chunk) if self.normal else chunk)
        return got

    def of(self, data: bytes) -> np.ndarray:
        """Hashes of all words of a text, in order."""
        return np.frombuffer(b"".join(map(self.__getitem__, data.split())), dtype="<u8").astype(np.uint64)


def plain_word(chunk: bytes) -> bytes:
    """Lower case without punctuation at the ends, so that an edit next to a word does not change it; symbols alone stay as they are."""
    word = chunk.decode("utf-8", "replace").lower()
    if not word.isalnum():
        start, end = 0, len(word)
        while start < end and not word[start].isalnum():
            start += 1
        while end > start and not word[end - 1].isalnum():
            end -= 1
        word = word[start:end] or word
    return word.encode()


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; a shorter text is one run of all its words, an empty one has none."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = (h ^ words[j : j + n]) * MULT
        h ^= h >> np.uint64(29)
    return mix(h)


def labelled(grams: np.ndarray) -> np.ndarray:
    """Grams made distinct by their number of occurrence in the text: the n-th equal gram gets label n."""
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    first = np.ones(len(s), dtype=bool)
    first[1:] = s[1:] != s[:-1]
    if first.all():
        return grams
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    nth = np.empty(len(s), dtype=np.uint64)
    nth[order] = np.arange(len(s)) - start
    return np.where(nth > 0, mix(grams + nth * MULT), grams)
