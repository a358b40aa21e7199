"""Word runs ("shingles") as 64-bit hashes, for whole Arrow batches at a time.

A text's shingle set holds every different run of ``k`` consecutive words once;
a text of fewer than ``k`` words is itself its only run.  Words are the pieces
between single blanks of the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> 64-bit hash; emptied when it holds ``most`` words, so that a worker's memory stays bounded."""

    most = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_WORDS = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (a bijection on 64 bits)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def word_hashes(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Flat word hashes and the offset at which each text starts (one more than there are texts)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.fromiter((h for ws in words for h in map(_WORDS.__getitem__, ws)), U, int(at[-1]))
    return flat, at


def runs(flat: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and the number of the text each belongs to, repeats kept."""
    sizes = np.diff(at)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    if not len(flat):
        return np.empty(0, U), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        acc = flat * GOLD
        left = np.minimum(sizes, k)  # words of a run: k, or all of a shorter text
        length = np.repeat(left, sizes)
        for j in range(1, k):
            nxt = np.zeros_like(flat)
            nxt[:-j or None] = flat[j:]
            acc = np.where(j < length, mix(acc) + nxt * GOLD, acc)
        acc = mix(acc)
    place = np.arange(len(flat)) - np.repeat(at[:-1], sizes)
    keep = place <= np.repeat(sizes - left, sizes)
    return acc[keep], text_of[keep]


def shingle_sets(texts: Iterable[str], k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted, distinct run hashes of each text."""
    words = [t.lower().split(" ") for t in texts]
    flat, at = word_hashes(words)
    h, owner = runs(flat, at, k)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[first], owner[first]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))
    return h, offsets.astype(np.int64)


def likeness(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of two arrays of distinct shingles (null where both are empty)."""
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


CELL_BITS = 18


def cells(h: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """The counter of a fixed-size frequency sketch that a shingle falls on."""
    return (mix(h ^ U(0xD1B54A32D192ED03)) >> U(64 - bits)).astype(np.int64)
