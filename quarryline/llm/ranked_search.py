"""Ranked lexical search by max trees and best-first branch and bound.

Every document becomes one row of postings: its length and the counts of those
of its words that any item asks for. Runs of such documents, in order of their
ids, become max trees: a term's leaf is its part of a document's score, a node
is the largest leaf of its range. An item's bound at a node is the sum of its
terms' nodes. The search always opens the node with the highest bound, the one
of smaller ids among equals, and ends when no bound can reach the twentieth best;
a bound that equals it is opened while its range may hold a smaller doc_id. A
task's later trees start with the best that its earlier ones have found. Spark
then ranks the best of all tasks.

Items are held in blocks of about `BLOCK_CHARS` characters, each a pass over the
texts; what comes to the driver is a block's items and the document counts of
its terms. A tree has at most `CELLS` leaves.

Defined results: null and empty texts have no terms; a null doc_id comes after
all others; rows that repeat a document are documents of their own; rows that
repeat an item's item_id and text are one item, equal item_ids with different
texts are items of their own; long texts are read whole; empty tables yield no
rows; other columns don't matter.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, durable, written
from .words import chunks

TOP = 20
BLOCK_CHARS = 4_000_000
FANOUT = 16
#: Most documents and most leaves (terms x documents) of the trees of one run.
RUN, CELLS = FANOUT**3, 6_000_000
#: A null doc_id in comparisons: behind every 64-bit number.
NOWHERE = 2**63
#: ASCII letters, as small ones, digits, and all bytes of other characters; all else separates terms.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(BYTES).split() if text else []


def postings(vocabulary):
    """(doc_id, text) -> (doc_id, n, terms, counts) of the documents that have terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"]
            for part in chunks(pa.compute.utf8_length(texts).fill_null(0).to_pylist()):
                n, ends, terms, counts = [], [0], [], []
                for text in texts[part].to_pylist():
                    words = terms_of(text)
                    found = Counter(map(number.get, words))
                    found.pop(None, None)
                    n.append(len(words))
                    terms += found.keys()
                    counts += found.values()
                    ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.int32()), (counts, pa.int64()))]
                rows = pa.RecordBatch.from_arrays([ids[part], pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])
                yield rows.filter(pa.compute.greater(rows["n"], 0))

    return run


class Trees:
    """Max trees of a run of documents: `levels` from the root's children down to the leaves, (term, node) each."""

    def __init__(self, ids: list[int], doc: np.ndarray, terms: np.ndarray, scores: np.ndarray):
        self.ids = ids
        self.row = {t: i for i, t in enumerate(np.unique(terms).tolist())}
        size = FANOUT
        while size < len(ids):
            size *= FANOUT
        leaves = np.zeros((len(self.row), size), np.int64)
        leaves[np.searchsorted(np.unique(terms), terms), doc] = scores
        self.levels = [leaves]
        while self.levels[0].shape[1] > FANOUT:
            below = self.levels[0]
            self.levels.insert(0, below.reshape(len(below), -1, FANOUT).max(axis=2))

    def search(self, item: Counter, best: list[tuple[int, int]], top: int = TOP) -> None:
        """Puts this run's documents into `best`: (-score, id), ascending, `top` at most."""
        mine = [(self.row[t], r) for t, r in item.items() if t in self.row]
        rows, times = np.array([x for x, _ in mine], np.int64), np.array([r for _, r in mine], np.int64)
        if not mine:
            return
        last = len(self.levels) - 1
        spans = [FANOUT ** (last - level) for level in range(last + 1)]  # documents below a node
        heap: list[tuple[int, int, int, int]] = []

        def opened(level: int, first: int) -> None:
            bounds = times @ self.levels[level][rows, first : first + FANOUT]
            for k in np.flatnonzero(bounds).tolist():
                at = first + k
                if at * spans[level] < len(self.ids):
                    entry = (-int(bounds[k]), self.ids[at * spans[level]])
                    if len(best) < top or entry < best[-1]:
                        if level == last:  # a document: its bound is its score
                            insort(best, entry)
                            del best[top:]
                        else:
                            heap.append((*entry, level, at)) if level == 0 else heappush(heap, (*entry, level, at))

        opened(0, 0)
        heapify(heap)
        while heap:
            bound, least, level, at = heappop(heap)
            if len(best) == top and (bound, least) >= best[-1]:
                break  # neither a higher score nor, among equals, a smaller id is left
            opened(level + 1, at * FANOUT)


def runs(ids: pa.Array, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Trees]:
    """Trees over the postings of a batch, in order of doc_id."""
    known = [NOWHERE if i is None else i for i in ids.to_pylist()]
    order = np.array(sorted(range(len(known)), key=known.__getitem__), np.int64)
    at = 0
    while at < len(order):
        size = min(RUN, len(order) - at)
        while True:
            mine = order[at : at + size]
            length = ends[mine + 1] - ends[mine]
            doc = np.repeat(np.arange(size), length)
            place = np.repeat(ends[mine], length) + np.arange(len(doc)) - np.repeat(np.cumsum(length) - length, length)
            if size <= FANOUT or len(np.unique(terms[place])) * size <= CELLS:
                break
            size = max(FANOUT, size // 2)
        tf, m = counts[place], 100 - 25 + (25 * n[mine] * n_docs) // n_terms
        yield Trees([known[i] for i in mine.tolist()], doc, terms[place], weights[terms[place]] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])))
        at += size


def searcher(items, weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    """Postings -> (item, doc_id, score): the task's best for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items.value]
        for batch in batches:
            lists = batch["terms"]
            ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (lists, batch["counts"])]
            for trees in runs(batch["doc_id"], batch["n"].to_numpy(), ends, *flat, weights, n_docs, n_terms):
                for item, found in zip(items.value, best, strict=True):
                    trees.search(item, found, top)
        out = [(k, None if i == NOWHERE else i, -s) for k, found in enumerate(best) for s, i in found]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "doc_id", "score"])

    return run


def search_block(rows: DataFrame, items: list[tuple[int | None, str]], top: int) -> DataFrame:
    """(item, doc_id, score): the best documents of every task for the items of one block."""
    spark = rows.sparkSession
    asked = [Counter(terms_of(text)) for _, text in items]
    number = {t: i for i, t in enumerate(sorted({t for a in asked for t in a}))}
    docs = written(rows.mapInArrow(postings(spark.sparkContext.broadcast(number)), "doc_id long, n long, terms array<int>, counts array<long>"))
    n_docs, n_terms = docs.agg(F.count("*"), F.sum("n")).first()
    weights = np.zeros(len(number), np.int64)
    for term, df in docs.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    held = spark.sparkContext.broadcast([Counter({number[t]: r for t, r in a.items()}) for a in asked])
    return docs.mapInArrow(searcher(held, weights, n_docs, n_terms or 1, top), "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, text, rank, doc_id, score): each item's `top` documents with a score above 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = durable(items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct())
    blocks = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    block, found = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)), []
    for i in range(blocks):
        held = [tuple(r) for r in asked.where(block == i).collect()]
        best = search_block(rows, held, top)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = rows.sparkSession.createDataFrame([(k, *x) for k, x in enumerate(held)], "item long, item_id long, text string")
        out = ranked.join(F.broadcast(names), "item").select("item_id", "text", "rank", "doc_id", "score")
        found.append(out if blocks == 1 else durable(out))
    return reduce(DataFrame.unionByName, found)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("item_id", "rank", "doc_id", "score")
