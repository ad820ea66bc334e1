"""MinHash near-dedup by BagMinHash signatures.

A text is the bag of its shingles of five words. Each shingle has hierarchical
Poisson processes over its discretised weight: one for level 0, then one for
each dyadic block of levels, with a rate in proportion to the block. A point
has a time, a signature position and a level, and counts if the bag holds the
shingle that often; a position keeps its earliest time. Two bags agree at a
position with probability equal to their weighted Jaccard similarity, exactly,
and a process stops when its next point is later than all positions' times.

Signatures are cut in bands. Every member of a bucket is verified against its
centre by exact multiset overlap of the whole texts; verified links join texts
to classes. Where a bucket then still holds several classes, all its members
are compared: it is dealt in blocks of bounded size, a task holds two of them
and gets all their overlaps from products of matrices, and returns only which
classes its links join. So no pair of a bucket goes untested, and none is a row.

Exact copies are one text throughout: they join the class of the first.

Defined results: a null or empty text has no shingles and is in a class with
its copies only; a text of under five words is one shingle; rows that share
doc_id and text are one document, rows of a null doc_id those that share the
text; of several texts of one doc_id each is a document of its own; documents
without a doc_id of their own get numbers behind the largest; an empty table
yields no rows; the class id is the least id of its class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import with_ids
from .fingerprints import mix
from .shared import bounded, compact, components, documents, durable, fresh
from .words import Rolling, WordHashes, chunks, spread, words_of

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 6
BLOCK_CHARS, BLOCK_MEMBERS = 2_000_000, 400  # of a block of a bucket, about; a longer text is a block of its own
CELLS = 8_000_000  # of a matrix at a time
KNOWN = WordHashes()


def bags(texts: list[str | None], known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, weight) of the texts, sorted by the first two."""
    split = [words_of(t) for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    rolling = Rolling(known.array([x for w in split for x in w]))
    doc, pos = spread(np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1)))
    h = rolling.at((np.cumsum(n) - n)[doc] + pos, np.minimum(n, SHINGLE)[doc])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(doc)))


def signatures(count: int, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """(count, k) earliest times; infinite for texts without shingles."""
    blocks = np.where(weight > 1, np.floor(np.log2(np.maximum(weight - 1, 1))).astype(np.int64) + 2, 1)
    of, block = spread(blocks)
    doc, weight = doc[of], weight[of]
    lowest = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)  # levels lowest .. lowest + width - 1
    width = np.maximum(lowest, 1)
    seed = mix(shingle[of] + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3)
    time, held = np.zeros(len(doc)), np.full(count * k, np.inf)
    latest, turn = np.full(count, np.inf), 0
    while len(doc):
        z = mix(seed + np.uint64(turn), 5)
        time = time - np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (width * k)
        z = mix(z, 6)
        place = ((z & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        level = lowest + ((z >> np.uint64(32)) * width.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        counts = level < weight
        np.minimum.at(held, doc[counts] * k + place[counts], time[counts])
        touched = np.unique(doc)
        latest[touched] = held.reshape(count, k)[touched].max(axis=1)
        going = time < latest[doc]
        doc, weight, lowest, width, seed, time = (x[going] for x in (doc, weight, lowest, width, seed, time))
        turn += 1
    return held.reshape(count, k)


def band_keys(times: np.ndarray) -> np.ndarray:
    bits = times.view(np.uint64).reshape(len(times), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bits.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key ^ bits[:, :, r], 19 + r)
    return key.view(np.int64)


def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, keys), for texts with shingles."""
    known = WordHashes()
    for batch in batches:
        texts, nodes = batch["text"], batch["node"].to_numpy()
        for part in chunks(pa.compute.utf8_length(texts).fill_null(0).to_pylist()):
            own = texts[part].to_pylist()
            times = signatures(len(own), *bags(own, known))
            some = np.flatnonzero(np.isfinite(times[:, 0]))
            keys = band_keys(times[some]).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[part][some]), lists], ["node", "keys"])


def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> the pairs (a, b) whose bags are similar enough."""
    known = WordHashes()
    for batch in batches:
        a, b, keep = batch["a"].to_numpy(), batch["b"].to_numpy(), []
        last = (None, None)
        for i, (x, y) in enumerate(zip(batch["text_a"], batch["text_b"], strict=True)):
            x, y = x.as_py(), y.as_py()
            if last[0] != x:
                last = (x, bags([x], known))
            (_, p, m), (_, q, n) = last[1], bags([y], known)
            if min(m.sum(), n.sum()) < SIMILAR * max(m.sum(), n.sum()):
                continue
            _, i_p, i_q = np.intersect1d(p, q, assume_unique=True, return_indices=True)
            both = np.minimum(m[i_p], n[i_q]).sum()
            if both >= SIMILAR * (m.sum() + n.sum() - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def joined_in(block: pa.Table) -> pa.Table:
    """(label, text) of two blocks of a bucket -> (a, b): each label that links join to others, and the least of them."""
    texts, labels = block["text"].to_pylist(), block["label"].to_numpy()
    doc, shingle, weight = bags(texts, KNOWN)
    of, nth = spread(weight)
    doc, token = doc[of], mix(shingle[of] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 41)  # a bag as a set
    order = np.argsort(token)
    doc, token = doc[order], token[order]
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    holders = np.diff(np.append(starts, len(token)))
    # tokens that the same texts hold are one column
    same = np.add.reduceat(mix(np.arange(len(texts), dtype=np.uint64), 43)[doc], starts)
    _, column, count = np.unique(same, return_index=True, return_counts=True)
    column, count = column[holders[column] > 1], count[holders[column] > 1]
    size = np.bincount(doc, minlength=len(texts))
    kind = np.float32 if size.max() < 2**24 else np.float64  # whole numbers stay exact
    both, step = np.zeros((len(texts), len(texts)), kind), max(1, CELLS // len(texts))
    for at in range(0, len(column), step):
        c, k = column[at : at + step], count[at : at + step].astype(kind)
        i, nth = spread(holders[c])
        held = np.zeros((len(texts), len(c)), kind)
        held[doc[starts[c][i] + nth], i] = 1
        both += (held * k) @ held.T
    both = both.astype(np.float64)
    linked = (both >= SIMILAR * (size[:, None] + size[None, :] - both)) | (labels[:, None] == labels[None, :])
    least, before = labels, None
    while before is None or (least != before).any():
        before, least = least, np.where(linked, least[None, :], np.iinfo(np.int64).max).min(axis=1)
    moved = np.unique(np.stack([labels, least], 1)[labels != least], axis=0)
    return pa.table({"a": moved[:, 0], "b": moved[:, 1]})


def with_nodes(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a column that numbers its documents, and that column's name.

    A document's number is its doc_id. Only rows without one, and further texts
    of a doc_id that has several, get numbers that no doc_id has.
    """
    node, id_, h1, h2, new = fresh(docs, "node", "node_id", "node_h1", "node_h2", "node_new")
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), h1: F.xxhash64("text"), h2: F.xxhash64(F.lit(1), "text")})
    text = F.struct(h1, h2)
    per = keyed.groupBy(id_).agg(F.min(text).alias("lo"), F.max(text).alias("hi"))
    odd = durable(per.where(F.col(id_).isNull() | (F.col("lo") != F.col("hi"))).select(F.col(id_).alias("id"), F.when(F.col(id_).isNotNull(), F.col("lo")).alias("lo")))
    if odd.isEmpty():
        return docs.withColumn(node, F.col("doc_id").cast("long")), node
    own = keyed.select(F.col(id_).alias("of"), h1, h2).join(bounded(odd), F.col("of").eqNullSafe(F.col("id")))
    more = durable(own.where(F.col("lo").isNull() | (F.col("lo") != text)).select(F.struct("of", h1, h2).alias("at")).distinct())
    least, most = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    least, most, n = least or 0, most or 0, more.count()
    numbered = with_ids(more, "at", most if most + n < 2**63 else least - n - 1)
    numbered = bounded(numbered.select(F.col("at.of").alias("of"), F.col(f"at.{h1}").alias("t1"), F.col(f"at.{h2}").alias("t2"), F.col("id").cast("long").alias(new)))
    same = F.col(id_).eqNullSafe(F.col("of")) & (F.col(h1) == F.col("t1")) & (F.col(h2) == F.col("t2"))
    return keyed.join(numbered, same, "left").select(*docs.columns, F.coalesce(new, id_).alias(node)), node


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar. Only texts in a pair are moved."""
    some = bounded(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    moved = texts.join(some, "node", "left_semi")  # no partitioning of our own, so that Spark can split a hot centre's pairs
    one = pairs.join(moved.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(moved.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return compact(two.select("a", "b", "text_a", "text_b").mapInArrow(overlap, "a long, b long").distinct())


def ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("b"), F.greatest(x, y).alias("a")]


def between(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): classes that links between members (key, node) of a bucket join."""
    mine = compact(members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    hashes = F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")
    mixed = mine.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), *hashes).where("lo < hi")
    mixed = compact(mixed.groupBy("x", "y", "n").agg(F.min("key").alias("key")).select("key", "n"))  # of buckets with the same members, one
    wanted = compact(mine.join(mixed, "key"))
    some = durable(texts.join(bounded(wanted.select("node").distinct()), "node", "left_semi"))
    chars = wanted.join(some.select("node", F.length("text").alias("chars")), "node").groupBy("key").agg(F.sum("chars").alias("chars"), F.max("n").alias("n"))
    blocks = compact(chars.select("key", F.ceil(F.greatest(F.col("chars") / BLOCK_CHARS, F.col("n") / BLOCK_MEMBERS)).cast("int").alias("blocks")))
    placed = wanted.join(blocks, "key").withColumn("i", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (j != F.col("i")) | (F.col("blocks") == 1))
    dealt = placed.select("key", "node", "label", "i", F.explode(others).alias("j")).select("key", "node", "label", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    held = compact(dealt).join(some, "node").select("key", "i", "j", "label", "text")
    return held.groupBy("key", "i", "j").applyInArrow(joined_in, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node and class_id for every row of `docs`."""
    h1, h2 = F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")
    docs, node = with_nodes(docs.select("doc_id", "text"))
    keys = docs.select("doc_id", node, h1, h2)
    # only texts with copies need a row; it is written, so that Spark can split a hot text's rows in joins
    many = compact(keys.groupBy("h1", "h2").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").drop("last"))
    copies = keys.join(many, ["h1", "h2"]).where("node != first").select("node")

    texts, again = docs.select(node, "text"), durable(docs.groupBy(node).count().where("count > 1").select(node))
    if not again.isEmpty():  # of repeated rows one is enough
        again = bounded(again)
        texts = texts.join(again, node, "left_anti").unionByName(texts.join(again, node, "left_semi").dropDuplicates([node]))
    rows = texts.mapInArrow(banded, "node long, keys array<long>").join(copies, "node", "left_anti").select("node", F.explode("keys").alias("key")).repartition("key")
    shared = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    members = compact(rows.join(shared, "key").select("key", "node", "n").distinct())
    # the centre of a bucket is who meets most others in all buckets: of a group of near copies, likely the original
    weight = members.groupBy("node").agg(F.sum("n").alias("w"))
    central = F.struct(F.col("w"), -F.col("node"))
    centres = members.join(weight, "node").groupBy("key").agg(F.max_by("node", central).alias("centre"))
    members = members.drop("n")

    tested = compact(members.join(centres, "key").where("node != centre").select(*ordered("node", "centre")).distinct())
    labels = components(verified(tested, texts))
    joined = components(between(members, labels, texts))
    moved = labels.join(joined.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    labels = compact(moved.unionByName(joined.join(labels, "node", "left_anti")))

    own = compact(many.join(labels.withColumnRenamed("node", "first"), "first", "left").select("h1", "h2", F.coalesce("label", "first").alias("copy_class")))
    out = keys.join(own, ["h1", "h2"], "left").join(labels, "node", "left")
    return out.select("doc_id", "node", F.coalesce("copy_class", "label", "node").alias("class_id"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).select("doc_id", "class_id")
