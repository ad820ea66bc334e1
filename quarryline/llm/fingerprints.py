"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs (lines, cut at sentence ends and again every `UNIT`
characters) are hashed with their number of earlier equals, so that a text is a
set of digests. A sketch adds each digest to three cells: a count, a sum of
digests and a sum of checks. Two sketches of one size subtract cell by cell,
and peeling the cells that hold a single digest recovers which digests only one
text has. Where peeling gets stuck, larger sketches of the same digests are
tried, until the difference is whole. Likeness is shared over all digests.

Defined results: a null text is empty; two empty texts are alike (1); rows are
ordered by doc_id (null first), then text hash and text; of repeated rows each is the next of
the one before; the last row's next is the first; a single row's next is
itself; an empty table yields no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, fresh
from .words import chunks, spread

CELLS = 12  # of the published sketch, and of the first try
GROWTH = 4
UNIT = 48
BUCKETS = 65_536
ROWS_A_BUCKET, SAMPLED = 200, 20  # SAMPLED: ids a bucket that its bounds are taken from
CHUNK = 400_000
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def paragraphs(text: str) -> list[str]:
    out = []
    for line in text.replace(". ", ".\n").split("\n"):
        if len(line) <= UNIT:
            out.append(line)
        else:
            out += [line[i : i + UNIT] for i in range(0, len(line), UNIT)]
    return out if text else []


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, digest), a set per text: repeats are told apart by their rank."""
    split = [paragraphs(t) for t in texts]
    doc, _ = spread(np.array([len(s) for s in split], np.int64))
    h = np.fromiter((xxhash.xxh3_64_intdigest(p) for s in split for p in s), np.uint64, len(doc))
    order = np.lexsort((h, doc))
    d, h = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    group = np.cumsum(new) - 1
    rank = np.arange(len(d)) - np.flatnonzero(new)[group]
    return d, np.where(rank > 0, mix(h + rank.astype(np.uint64), 7), h)


class Sketches:
    """Sketches of many texts side by side; `cells[i]` (a multiple of 3) are text i's."""

    def __init__(self, cells: np.ndarray):
        self.third, self.base = cells // 3, np.cumsum(cells) - cells
        self.count = np.zeros(cells.sum(), np.int64)
        self.keys, self.checks = np.zeros(cells.sum(), np.uint64), np.zeros(cells.sum(), np.uint64)
        self.owner = np.repeat(np.arange(len(cells)), cells)

    def add(self, doc: np.ndarray, key: np.ndarray, sign: int | np.ndarray) -> list[np.ndarray]:
        """Puts digests in, or takes them out; the cells that changed."""
        sign = np.broadcast_to(np.asarray(sign, np.int64), doc.shape)
        signed = key * sign.astype(np.uint64)
        check, changed = mix(key, 11) * sign.astype(np.uint64), []
        for j in range(3):
            at = self.base[doc] + j * self.third[doc] + (mix(key, j + 1) % self.third[doc].astype(np.uint64)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, signed)
            np.add.at(self.checks, at, check)
            changed.append(at)
        return changed

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Per text: how many digests of either sign were recovered, and whether that is all; then (text, digest, sign) of them."""
        n = len(self.base)
        plus, minus, got = np.zeros(n, np.int64), np.zeros(n, np.int64), []
        at = np.arange(len(self.count))
        while True:
            at = at[np.abs(self.count[at]) == 1]
            key = self.keys[at] * self.count[at].astype(np.uint64)
            pure = self.checks[at] * self.count[at].astype(np.uint64) == mix(key, 11)
            at, key = at[pure], key[pure]
            if not len(at):
                break
            doc, sign = self.owner[at], self.count[at]
            _, first = np.unique(mix(key, 13) ^ mix(doc.astype(np.uint64), 17), return_index=True)
            doc, key, sign = doc[first], key[first], sign[first]
            plus += np.bincount(doc[sign > 0], minlength=n)
            minus += np.bincount(doc[sign < 0], minlength=n)
            got.append((doc, key, sign))
            at = np.concatenate(self.add(doc, key, -sign))  # only these can have become single
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        return plus, minus, np.bincount(self.owner[left], minlength=n) == 0, got

    def text_of(self, i: int) -> str:
        own = slice(self.base[i], self.base[i] + 3 * self.third[i])
        return base64.b64encode(self.count[own].astype("<i4").tobytes() + self.keys[own].astype("<u8").tobytes() + self.checks[own].astype("<u4").tobytes()).decode()


def publish(n: int, sets: tuple[np.ndarray, np.ndarray]) -> list[str]:
    s = Sketches(np.full(n, CELLS))
    s.add(*sets, 1)
    return [s.text_of(i) for i in range(n)]


def likeness(n: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list]:
    """Shared over all digests of the texts i of a and b, from differences of their sketches; and (text, digest, sign) of these."""
    size_a, size_b = np.bincount(a[0], minlength=n), np.bincount(b[0], minlength=n)
    out, differing = np.ones(n), []
    todo, cells = np.arange(n), np.full(n, CELLS)
    low = np.abs(size_a - size_b)  # so many digests differ at least
    while len(todo):
        while (small := cells[todo] < 1.5 * low[todo]).any():
            cells[todo[small]] *= GROWTH
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        s = Sketches(cells[todo])
        for (doc, key), sign in ((a, 1), (b, -1)):
            mine = place[doc] >= 0
            s.add(place[doc[mine]], key[mine], sign)
        plus, minus, whole, got = s.peel()
        differing += [(todo[doc[whole[doc]]], key[whole[doc]], sign[whole[doc]]) for doc, key, sign in got]
        done = todo[whole]
        total = size_a[done] + minus[whole]
        out[done] = np.where(total > 0, (size_a[done] - plus[whole]) / np.maximum(total, 1), 1.0)
        todo = todo[~whole]
        cells[todo] *= GROWTH
    return out, differing


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, with a copy of the next bucket's first row at its end."""

    def pairs() -> Iterator[tuple]:
        before = None
        for batch in batches:
            for *at, copy, doc_id, text in zip(*(batch[c].to_pylist() for c in ("bucket", "sub", "copy", "doc_id", "text")), strict=True):
                row = (at, copy, doc_id, text)
                if before and before[0] == row[0] and not before[1]:
                    yield before[2], before[3] or "", row[3] or ""
                before = row

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        n = len(rows)
        ids, texts, following = zip(*rows, strict=True)
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        own, other, after = digests(texts), digests(changed), digests(following)
        cols = [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]),
            pa.array(publish(n, own)), pa.array(publish(n, other)),
            pa.array(likeness(n, own, other)[0]), pa.array(likeness(n, own, after)[0]),
        ]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in OUT.split(", ")])

    held, size = [], 0
    for row in pairs():
        held.append(row)
        size += len(row[1]) + len(row[2])
        if size > CHUNK:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def in_buckets(docs: DataFrame) -> DataFrame:
    """Rows by (doc_id, text hash, text) in ranges (`bucket`, `sub`), with copies of each range's first rows at the end of the one before.

    A doc_id that fills several ranges is cut by the hashes of its texts. What
    comes to the driver is bounded by BUCKETS.
    """
    own = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("ord"), F.xxhash64("text").alias("tie"))
    n = docs.count()
    many = max(1, min(BUCKETS, n // ROWS_A_BUCKET))
    got = sorted(r[0] for r in own.select("ord").sample(min(1.0, SAMPLED * many / max(n, 1)), 7).collect()) if many > 1 else []
    cuts = Counter(got[i * len(got) // many] for i in range(1, many)) if got else {}
    splits, hot = [-math.inf], []
    for v in sorted(cuts):
        if float(v) > splits[-1]:
            splits.append(float(v))
        if cuts[v] > 1:
            hot.append((len(splits) - 1, v, cuts[v]))
    keyed = own.withColumn("at", F.col("ord").cast("double"))
    keyed = Bucketizer(splits=[*splits, math.inf], inputCol="at", outputCol="bucket").transform(keyed) if len(splits) > 1 else keyed.withColumn("bucket", F.lit(0))
    keyed = keyed.withColumn("bucket", F.col("bucket").cast("int")).drop("at")
    held = docs.sparkSession.createDataFrame(hot, "bucket int, v long, parts int")
    part = F.floor((F.col("tie") / 2.0**64 + 0.5) * F.col("parts")).cast("int")
    sub = F.when(F.col("v").isNull(), 0).when(F.col("ord") < F.col("v"), -1).when(F.col("ord") == F.col("v"), F.least(part, F.col("parts") - 1)).otherwise(F.col("parts"))
    keyed = keyed.join(F.broadcast(held), "bucket", "left").withColumn("sub", sub).drop("v", "parts")
    firsts = sorted((r["bucket"], r["sub"], r["first"]) for r in keyed.groupBy("bucket", "sub").agg(F.min(F.struct("ord", "tie")).alias("first")).collect())
    before = [(b, s, *first, *firsts[i - 1][:2]) for i, (b, s, first) in enumerate(firsts)]
    held = docs.sparkSession.createDataFrame(before, "bucket int, sub int, first_ord long, first_tie long, before int, before_sub int")
    place = lambda b, s, copy: F.struct(F.col(b).alias("bucket"), F.col(s).alias("sub"), F.lit(copy).alias("copy"))
    is_first = (F.col("ord") == F.col("first_ord")) & (F.col("tie") == F.col("first_tie"))
    at = F.when(is_first, F.array(place("bucket", "sub", False), place("before", "before_sub", True))).otherwise(F.array(place("bucket", "sub", False)))
    return keyed.join(F.broadcast(held), ["bucket", "sub"]).select("doc_id", "tie", "text", F.explode(at).alias("at")).select("at.bucket", "at.sub", "at.copy", "doc_id", "tie", "text")


def fingerprint(docs: DataFrame) -> DataFrame:
    rows = in_buckets(docs).repartition("bucket", "sub").sortWithinPartitions("bucket", "sub", "copy", "doc_id", "tie", "text")
    return rows.mapInArrow(compare, OUT)


def difference(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """(`key`, digest, sign): the paragraph digests that only the new text (1) or only the old one (-1) of a key has.

    Peeled from the difference of their sketches; keys of one side alone differ from the empty text, and no key is a key
    like any other. Rows that share a key are paired in the order of their texts' hashes, so that repeats don't multiply.
    The columns have underscores in front where `key` has such a name.
    """
    nth = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("text"), "text"))
    mine, theirs = (x.select(F.col(key).alias("k"), "text").withColumn("nth", nth) for x in (new, old))
    same = mine["k"].eqNullSafe(theirs["k"]) & (mine["nth"] == theirs["nth"])
    both = mine.join(theirs, same, "full").select(F.coalesce(mine["k"], theirs["k"]).alias("k"), mine["text"].alias("new"), theirs["text"].alias("old"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [[t or "" for t in batch[c].to_pylist()] for c in ("new", "old")]
            for part in chunks([len(a) + len(b) for a, b in zip(*texts, strict=True)], CHUNK):
                doc, digest, sign = [], [], []
                n = len(texts[0][part])
                _, got = likeness(n, digests(texts[0][part]), digests(texts[1][part]))
                for d, k, s in got:
                    doc.append(d)
                    digest.append(k)
                    sign.append(s)
                doc, digest, sign = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, digest, sign))
                order = np.lexsort((digest, doc))
                yield pa.RecordBatch.from_arrays([batch["k"][part].take(pa.array(doc[order])), pa.array(digest[order].astype(np.uint64).view(np.int64)), pa.array(sign[order].astype(np.int32))], ["k", "digest", "sign"])

    kind = both.schema["k"].dataType.simpleString()
    return both.mapInArrow(run, f"k {kind}, digest long, sign int").toDF(key, *fresh(new.select(key), "digest", "sign"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(documents(spark, sf_dir))
