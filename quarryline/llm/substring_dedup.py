"""Substring dedup by difference-cover anchors.

A run of 50 words that two documents share is found without hashing a window
at every word. Windows of 20 words are hashed only at positions whose residue
modulo 31 is in a difference cover: whatever the two alignments, some offset
below 31 puts an anchor of both documents at the same place of the run. Shared
anchors then extend: around them, and only there, the full windows are hashed
(128 bits) and the document that comes first decides which words go.

Exact copies of an earlier text need no anchors: all their windows start there.

Defined results: a null text has no words; a null doc_id comes after all
others, the largest number too; rows of one doc_id, or without one, don't remove
each other's words, and however many there are, their texts go to many tasks;
texts under 50 words keep all; a very long text is one row of a task, read
whole; an empty table yields no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bounded, documents, durable
from .words import BASES, Rolling, WordHashes, chunks, spread, words_of

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
LAST = 2**63 - 1
#: The key of a row in joins, and its lots: an id is split into this many; beyond are those of rows without an id.
ROW, NONE = ["ord", "sub"], 2**16


def once(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Places of the first of each (document, keys): a repeat inside a document says nothing new."""
    order = np.lexsort((*keys[::-1], doc))
    same = np.ones(max(len(order) - 1, 0), bool)
    for x in (doc, *keys):
        same &= x[order][1:] == x[order][:-1]
    return order[np.concatenate([[True], ~same])] if len(order) else order


def anchor_starts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of n words laid end to end: the anchors' documents, positions and places."""
    doc, pos = spread(n)
    at = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[pos % PERIOD] & (pos + ANCHOR <= n[doc]))
    return doc[at], pos[at], at


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, sub, text) -> (h, ord, sub) of the anchors of texts with a whole window."""
    known = WordHashes()
    for batch in batches:
        texts = batch["text"]
        for part in chunks(pa.compute.utf8_length(texts).fill_null(0).to_pylist()):
            split = [w if len(w) >= WINDOW else [] for w in map(words_of, texts[part].to_pylist())]
            doc, _, at = anchor_starts(np.array([len(w) for w in split]))
            h = Rolling(known.array([x for w in split for x in w])).at(at, ANCHOR)
            keep = once(doc, h)
            mine = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), *[batch[c][part].take(mine) for c in ROW]], ["h", *ROW])


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, sub, text, hashes of shared anchors) -> the windows (g1, g2, ord, sub) that hold one."""
    known = WordHashes()
    for batch in batches:
        texts, found = batch["text"], batch["shared"]
        for part in chunks(pa.compute.utf8_length(texts).fill_null(0).to_pylist()):
            split = [w if len(w) >= WINDOW else [] for w in map(words_of, texts[part].to_pylist())]
            n = np.array([len(w) for w in split])
            hashes = known.array([x for w in split for x in w])
            rolling = Rolling(hashes)
            doc, _, at = anchor_starts(n)
            h, near = rolling.at(at, ANCHOR).view(np.int64), np.zeros(len(hashes) + 1, np.int32)
            cut, first = np.searchsorted(doc, np.arange(len(split) + 1)), np.cumsum(n) - n
            for i, mine in enumerate(found[part]):
                own = at[cut[i] : cut[i + 1]][np.isin(h[cut[i] : cut[i + 1]], mine.values.to_numpy())]
                np.add.at(near, np.maximum(own - PERIOD + 1, first[i]), 1)
                np.add.at(near, own + 1, -1)
            doc, pos = spread(n)
            at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (pos + WINDOW <= n[doc]))
            g = [rolling.at(at, WINDOW), Rolling(hashes, BASES[1]).at(at, WINDOW)]
            keep = once(doc[at], *g)
            mine = pa.array(doc[at][keep])
            yield pa.RecordBatch.from_arrays([*[pa.array(x[keep].view(np.int64)) for x in g], *[batch[c][part].take(mine) for c in ROW]], ["g1", "g2", *ROW])


def covered(hashes: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Which words of a text the windows whose hash is in `gone` cover."""
    g1 = Rolling(hashes).at(np.arange(len(hashes) - WINDOW + 1), WINDOW).view(np.int64)
    starts = np.concatenate([np.isin(g1, gone).astype(np.int32), np.zeros(WINDOW, np.int32)])
    starts[WINDOW:] -= starts[:-WINDOW].copy()
    return np.cumsum(starts)[: len(hashes)] > 0


def cleaned(with_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            out = []
            for text, copy, gone in zip(batch["text"], batch["is_copy"], batch["gone"], strict=True):
                words = words_of(text.as_py())
                n = len(words)
                if copy.as_py() and n >= WINDOW:
                    kept = []
                elif gone.is_valid and n >= WINDOW:
                    mask = covered(known.array(words), gone.values.to_numpy())
                    kept = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                else:
                    kept = words
                joined = b" ".join(kept)
                out.append((n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ROW], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], [*ROW, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return rows


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ord, sub, h1, h2), and with the text, of every row. `ord` is the doc_id; `sub` splits the rows that have none or
    share theirs, by their texts, so that joins by (ord, sub) meet no hot id; it also tells the largest id from none.
    Two texts of one id that get the same `sub` are only handled together."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    shared = bounded(ids.where("NOT none").groupBy("ord").count().where("count > 1").select("ord", F.lit(True).alias("shared")))
    lot = F.pmod("h1", F.lit(NONE)).cast("int")
    rows = ids.join(shared, "ord", "left").withColumn("sub", F.when(F.col("none"), lot + NONE).when(F.col("shared"), lot).otherwise(0))
    return rows.select(*ROW, "h1", "h2"), rows.select(*ROW, "h1", "text")


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept_text for every row."""
    place = F.struct((F.col("sub") >= NONE).alias("none"), "ord")  # what comes first; rows without an id come last, and together
    keys, rows = numbered(docs)
    # only texts with copies need a row; it is written, so that Spark can split a hot text's rows in the join
    many = durable(keys.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last"))
    copies = keys.join(many, ["h1", "h2"]).where(place > F.col("first")).groupBy(*ROW).agg(F.collect_set("h1").alias("copied"))
    texts = rows.repartition(*ROW)  # every later step reads this one exchange
    flagged = texts.join(copies, ROW, "left").select(*ROW, "text", F.coalesce(F.array_contains("copied", F.col("h1")), F.lit(False)).alias("is_copy"))
    own = flagged.where(~F.col("is_copy")).select(*ROW, "text")

    # a window and not a join with the shared ones: Spark would make the anchors, and the windows, once for either side;
    # over plain columns, as any other would go through the exchange with them
    extremes = lambda w: {"lo": F.min("ord").over(w), "hi": F.max("ord").over(w), "lo_sub": F.min("sub").over(w), "hi_sub": F.max("sub").over(w)}
    largest_and_none = (F.col("lo") == LAST) & (F.col("lo_sub") < NONE) & (F.col("hi_sub") >= NONE)
    found = own.mapInArrow(anchors, "h long, ord long, sub int").withColumns(extremes(Window.partitionBy("h")))
    places = found.where((F.col("lo") < F.col("hi")) | largest_and_none).groupBy(*ROW).agg(F.collect_list("h").alias("shared"))

    full = own.join(places, ROW).mapInArrow(windows, "g1 long, g2 long, ord long, sub int").withColumns(extremes(Window.partitionBy("g1", "g2")))
    later = (F.col("ord") > F.col("lo")) | (largest_and_none & (F.col("sub") >= NONE))
    gone = full.where(later).groupBy(*ROW).agg(F.collect_list("g1").alias("gone"))

    done = flagged.join(gone, ROW, "left").select(*ROW, "text", "is_copy", "gone")
    out = done.mapInArrow(cleaned(with_text), "ord long, sub int, n_words long, n_removed long, kept_sha256 string, kept_text string")
    cols = [F.when(F.col("sub") < NONE, F.col("ord")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
    return out.select(*cols)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
