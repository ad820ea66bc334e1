"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document leaks an item if some run of its words is within edit distance
`floor(0.2 * words)` of the whole item (words lower-cased, without punctuation).

The CGK random walk copies a window's words to three times its length, standing
still or moving on by a random bit of (step, word); windows at small edit
distance become strings at small Hamming distance. Sampling a few positions of
the strings, again and again, gives keys that similar windows share; windows
and items of one size that share a key are candidates, and an edit-distance
table over the words around them decides.

Only windows that can hold a leak are embedded: d edits leave one of an item's
d + 1 blocks whole, so a window needs a block of some item near its place. As
edits before the block move it, windows are embedded at its own place and 1, 2,
4, ... words further to either side, up to d. Of items that share a block at a
place and a size, the windows are made once. A pair that shares a key is
dropped without an edit table only where the text around the window lacks more
of the item's words than edits are allowed.

The benchmark comes to executors in blocks of about `BLOCK_CHARS` characters,
each of which all documents are held against, one after the other. Texts are
worked on in slices of bounded size, however many windows or items they hit.

Defined results: a null or empty text, or item, leaks nothing; repeated rows
yield repeated findings; of an item's runs in one text the nearest, then first
is returned; empty tables yield no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprints import mix
from .shared import documents, durable
from .words import Rolling, WordHashes, chunks, spread

SLACK = 0.2
WALKS, SAMPLES, BITS = 4, 8, 2
BLOCK_CHARS = 8_000_000  # of a block of the benchmark, about
HITS, EMBEDDED, VERIFIED = 1_000_000, 600_000, 6_000_000  # at a time: pairs looked up, words of windows, cells of edit tables
GRID = 8  # windows of long items start at multiples of this part of their edits
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
LEAK = "doc_id long, item_id long, start_word long, item_words long, distance long, similarity double"


def plain_words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(None, PUNCTUATION).split() if text else []


def slack(n: np.ndarray) -> np.ndarray:
    return np.floor(SLACK * n + 1e-9).astype(np.int64)


def embed(windows: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
    """CGK strings (window, step) of rows of words; 0 behind a window's end."""
    w, steps = len(windows), 3 * windows.shape[1]
    padded = np.concatenate([windows, np.zeros((w, 1), np.uint64)], axis=1)
    out = np.zeros((w, steps), np.uint64)
    at, rows = np.zeros(w, np.int64), np.arange(w)
    for j in range(steps):
        word = padded[rows, np.minimum(at, sizes)]
        out[:, j] = word
        at += (mix(word + np.uint64(j), 101 + walk) & np.uint64(1)).astype(np.int64) * (at < sizes)
    return out


def keys_of(windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(window, repetition): hashes of the size and the sampled positions' words."""
    out, places = [], np.random.default_rng(7).random((WALKS, SAMPLES, BITS))
    for walk in range(WALKS):
        strings = embed(windows, sizes, walk)
        for sample in range(SAMPLES):
            key = mix(sizes.astype(np.uint64), 211 + walk * SAMPLES + sample)
            for u in places[walk, sample]:
                key = mix(key ^ strings[np.arange(len(sizes)), (u * 3 * sizes).astype(np.int64)], 5)
            out.append(key)
    return np.stack(out, axis=1)


def distances(items: np.ndarray, sizes: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each item to any part of its run, and where that part ends."""
    c, width = runs.shape
    row, j = np.zeros((c, width + 1), np.int32), np.arange(width + 1, dtype=np.int32)
    last = np.zeros_like(row)
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (runs != items[:, i : i + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - j, axis=1) + j
        last = np.where((sizes == i + 1)[:, None], row, last)
    return last.min(axis=1), last.argmin(axis=1)


class Index:
    """A block of the benchmark, ready to be looked up. Items lie end to end in `words`."""

    def __init__(self, items: list[tuple[int, str | None]]):
        known = WordHashes()
        split = [(i, w) for i, t in items if (w := plain_words(t))]
        self.ids = np.array([i for i, _ in split], np.int64)
        self.sizes = np.array([len(w) for _, w in split], np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.words = known.array([x for _, w in split for x in w])
        self.slack = slack(self.sizes)
        self.bits = presence(self.words, self.start, self.sizes)
        # what windows start from: (hash, place, item's size) of the d + 1 blocks of each item, each once
        item, nth = spread(self.slack + 1)
        length = np.maximum(self.sizes // (self.slack + 1), 1)[item]
        h = Rolling(self.words).at(self.start[item] + nth * length, length)
        self.seeds = {}
        for q in np.unique(length).tolist():
            own = length == q
            rows = np.unique(np.rec.fromarrays([h[own], nth[own] * q, self.sizes[item[own]]], names="h,place,size"))
            maybe = np.zeros(1 << 20, bool)
            maybe[rows["h"] >> np.uint64(44)] = True
            self.seeds[q] = (maybe, *[np.array(rows[k]) for k in ("h", "place", "size")])
        keys, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for some in in_cells(self.sizes, EMBEDDED):
            n = self.sizes[some]
            keys.append(keys_of(cut(self.words, self.start[some], n, self.start[some], self.start[some] + n), n).ravel())
            owner.append(np.repeat(some, WALKS * SAMPLES))
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]

    def windows(self, hashes: np.ndarray, doc: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, size) of windows that hold a block of an item of that size near its place, some at a time."""
        rolling = Rolling(hashes)
        for q, (maybe, h, place, size) in self.seeds.items():
            at = np.arange(max(len(hashes) - q + 1, 0))
            at = at[doc[at] == doc[at + q - 1]] if len(at) else at
            g = rolling.at(at, q)
            some = maybe[g >> np.uint64(44)]
            at, g = at[some], g[some]
            lo, hi = np.searchsorted(h, g, "left"), np.searchsorted(h, g, "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            for some in in_cells(hi - lo, HITS):
                hit, nth = spread((hi - lo)[some])
                seed = lo[some][hit] + nth
                n, begin, low = size[seed], at[some][hit] - place[seed], first[doc[at[some][hit]]]
                far, found, shift = slack(n), [], 0
                grid = np.maximum(far // GRID, 1)
                while (fits := far >= shift).any():
                    for side in {shift, -shift}:
                        start = (begin[fits] + side) // grid[fits] * grid[fits]
                        found.append(np.maximum(start, low[fits]) << 32 | n[fits])
                    shift = 2 * shift or 1
                found = np.unique(np.concatenate(found))
                yield found >> 32, found & 0xFFFFFFFF

    def candidates(self, windows: np.ndarray, sizes: np.ndarray, around: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item) that share a key in some repetition, but for those that lack too many of the item's words
        `around` the window; some at a time."""
        keys = keys_of(windows, sizes)
        lo, hi = np.searchsorted(self.keys, keys.ravel(), "left"), np.searchsorted(self.keys, keys.ravel(), "right")
        hits = np.add.reduceat(hi - lo, np.arange(0, len(lo), keys.shape[1])) if len(lo) else lo
        for some in in_cells(hits, HITS):
            a, b = some[0] * keys.shape[1], (some[-1] + 1) * keys.shape[1]
            hit, nth = spread(hi[a:b] - lo[a:b])
            pairs = np.unique(some[0] + hit // keys.shape[1] << 32 | self.owner[lo[a:b][hit] + nth])
            window, item = pairs >> 32, pairs & 0xFFFFFFFF
            lacking = np.bitwise_count(self.bits[item] & ~around[window]).sum(axis=1)
            keep = lacking <= self.slack[item]
            yield window[keep], item[keep]


def in_cells(sizes: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Runs of places whose sizes add up to about `limit`, one place at least."""
    group = (np.cumsum(sizes) - sizes) // limit
    return iter(np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(group)) + 1)) if len(sizes) else iter(())


def presence(words: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(run, 4) bits, one set by each word of a run: a bit that a text lacks is a word that it lacks."""
    out = np.zeros((len(start), 4), np.uint64)
    for some in in_cells(sizes, EMBEDDED):
        run, nth = spread(sizes[some])
        w = mix(words[start[some][run] + nth], 61)
        np.bitwise_or.at(out, (some[run], (w >> np.uint64(6)).astype(np.int64) & 3), np.uint64(1) << (w & np.uint64(63)))
    return out


def cut(hashes: np.ndarray, start: np.ndarray, length: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows of words from `start`; 0 outside [low, high) and behind `length`."""
    at = start[:, None] + np.arange(max(length.max(initial=1), 1))
    inside = (at >= low[:, None]) & (at < high[:, None]) & (at < (start + length)[:, None])
    return np.where(inside, hashes[np.clip(at, 0, len(hashes) - 1)], np.uint64(0))


def nearest(index: Index, hashes: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """(document, item) -> (distance, first word) of the item's nearest run, of texts laid end to end."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for starts, sizes in index.windows(hashes, doc, first):
        order = np.argsort(sizes, kind="stable")
        for some in in_cells(sizes[order], EMBEDDED):
            start, size = starts[order[some]], sizes[order[some]]
            d, e = doc[start], slack(size)
            low, high = np.maximum(start - 2 * e, first[d]), np.minimum(start + size + 2 * e, first[d] + n[d])
            around = presence(hashes, low, high - low)
            for window, item in index.candidates(cut(hashes, start, size, first[d], first[d] + n[d]), size, around):
                # runs are sought up to 2 e words around a window, so that of windows within e words one is enough
                near = np.lexsort((start[window] // np.maximum(e[window], 1), d[window], item))
                window, item = window[near], item[near]
                at = np.stack([start[window] // np.maximum(e[window], 1), d[window], item])
                once = np.append(True, (at[:, 1:] != at[:, :-1]).any(axis=0))[: len(item)]
                window, item = window[once], item[once]
                for k in in_cells((size[window] + 1) * (size[window] + 4 * e[window]), VERIFIED):
                    w, i = window[k], item[k]
                    lo = start[w] - 2 * e[w]
                    runs = cut(hashes, lo, size[w] + 4 * e[w], first[d[w]], first[d[w]] + n[d[w]])
                    own = cut(index.words, index.start[i], index.sizes[i], index.start[i], index.start[i] + index.sizes[i])
                    far, end = distances(own, index.sizes[i], runs)
                    for j in np.flatnonzero(far <= e[w]).tolist():
                        key = (int(d[w[j]]), int(i[j]))
                        begin = max(int(lo[j] + end[j] - index.sizes[i[j]] - first[d[w[j]]]), 0)
                        best[key] = min(best.get(key, (10**9, 0)), (int(far[j]), begin))
    return best


def finder(items: list[tuple[int, str | None]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = Index(items), WordHashes()
        for batch in batches:
            texts, ids = batch["text"], batch["doc_id"]
            for part in chunks(pa.compute.utf8_length(texts).fill_null(0).to_pylist()):
                split = [plain_words(t) for t in texts[part].to_pylist()]
                n = np.array([len(w) for w in split], np.int64)
                hashes = known.array([x for w in split for x in w])
                found = sorted(nearest(index, hashes, np.repeat(np.arange(len(n)), n), np.cumsum(n) - n, n).items())
                item = np.array([k[1] for k, _ in found], np.int64)
                far = np.array([v[0] for _, v in found], np.int64)
                size = index.sizes[item] if len(found) else item
                yield pa.RecordBatch.from_arrays([
                    ids[part].take(pa.array([k[0] for k, _ in found], pa.int64())), pa.array(index.ids[item] if len(found) else item),
                    pa.array([v[1] for _, v in found], pa.int64()), pa.array(size), pa.array(far), pa.array(1 - far / np.maximum(size, 1)),
                ], [c.split()[0] for c in LEAK.split(", ")])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, ...) of every item that a document holds."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    block, found = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)), []
    for i in range(blocks):
        held = rows.mapInArrow(finder([tuple(r) for r in items.where(block == i).collect()]), LEAK)
        found.append(held if blocks == 1 else durable(held))  # a block's items leave the driver before the next come
    return reduce(DataFrame.unionByName, found)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
