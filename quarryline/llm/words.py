"""Words of whole texts as arrays of 64-bit hashes, and rolling hashes over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Odd multipliers of the two rolling hashes (arithmetic modulo 2**64).
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
CHUNK_CHARS = 3_000_000


class WordHashes(dict):
    """word -> 64-bit hash, computed once a word; forgets all when it holds too many."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and return."""
    return text.encode().split() if text else []


def chunks(sizes: list[int], limit: int = CHUNK_CHARS) -> Iterator[slice]:
    """Slices of rows that hold about `limit` in sum, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


class Rolling:
    """Hash of any run of words in O(1), by prefix sums of w[j] * base**j."""

    def __init__(self, hashes: np.ndarray, base: int = BASES[0]):
        n = len(hashes)
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers[:-1], out=self.sums[1:])
        self.unscale = np.full(n + 1, pow(base, -1, 2**64), np.uint64)
        self.unscale[0] = 1
        np.multiply.accumulate(self.unscale, out=self.unscale)

    def at(self, starts: np.ndarray, length) -> np.ndarray:
        h = (self.sums[starts + length] - self.sums[starts]) * self.unscale[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes, laid end to end: each item's group and place in it."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
