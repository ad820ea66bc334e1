"""Language ID by unigram pieces, summed over all segmentations.

Each language has probabilities of the pieces of a fixed public vocabulary,
learned by EM on expected piece counts. The forward algorithm sums a text's
probability over every segmentation; as the lattice of a text is the product of
its units' lattices, each distinct unit is summed once a task.

The fit takes about `SAMPLE` documents a language, chosen by a hash of doc_id;
prediction covers every text whole. Texts are lower-cased.

Defined results: `und` with score 0 where the text is null or has no letter, or
nothing could be learned; repeated rows are each predicted; an empty table
yields no rows; ties go to the first language in order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lattice import PIECES, Lattices, Vocabulary, spell, units_of
from .shared import documents, durable, held_out
from .words import chunks

SAMPLE = 1500
ROUNDS = 3
SMOOTH = 0.1
CACHE = 150_000
_letter = re.compile(r"[^\W\d_]").search


def count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(units_of(text.lower()))
        rows = [(k, u, n) for k, c in found.items() for u, n in c.items()]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "unit", "n"])


def expected(vocab: Vocabulary, log_p: np.ndarray, langs: list[str]):
    """(lang, unit, n) -> (lang, piece, expected count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, size = vocab.trie(), len(vocab.pieces)
        for batch in batches:
            total = np.zeros((size, len(langs)))
            owner = np.array([langs.index(x) for x in batch["lang"].to_pylist()])
            units, n = batch["unit"].to_pylist(), batch["n"].to_numpy()
            for k in range(len(langs)):
                mine = np.flatnonzero(owner == k)
                for part in chunks([len(units[i]) for i in mine], 300_000):
                    rows, spelt = mine[part], {}
                    lat = Lattices([units[i] for i in rows], trie, size, spelt)
                    own = spell(log_p[:, k], spelt, vocab.byte_ids)
                    choice = lat.choice(own, lat.suffix_mass(own))
                    weight = lat.visits(choice) * np.repeat(n[rows], np.diff(lat.first))[lat.start]
                    used = np.bincount(lat.piece, weight, size + len(spelt))
                    total[:, k] += used[:size]
                    for c, i in spelt.items():
                        np.add.at(total[:, k], np.array(vocab.byte_ids)[list(c.encode())], used[size + i])
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, k])], ["k", "piece", "used"])

    return run


def fit(labelled: DataFrame, vocab: Vocabulary, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (piece, language). What comes to the driver is bounded by the vocabulary."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs, size = sorted(sizes), len(vocab.pieces)
    if not langs:
        return [], np.zeros((size, 0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / sizes[k]))])
    lot = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = rows.where(lot < share[F.col("lang")]).select("lang", "text")
    units = durable(chosen.mapInArrow(count_units, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n")).repartition("unit"))
    log_p = np.repeat(vocab.log_weight[:, None], len(langs), axis=1)
    may = np.isfinite(vocab.log_weight)
    for _ in range(rounds):
        got = units.mapInArrow(expected(vocab, log_p, langs), "k int, piece int, used double").groupBy("k", "piece").agg(F.sum("used").alias("used")).toPandas()
        used = np.zeros((size, len(langs)))
        used[got["piece"], got["k"]] = got["used"]
        used[may] += SMOOTH
        with np.errstate(divide="ignore"):
            log_p = np.log(used / used.sum(axis=0))
    return langs, log_p


def predictor(vocab: Vocabulary, langs: list[str], log_p: np.ndarray):
    log_p = np.where(np.isfinite(log_p), log_p, -1e4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, size = vocab.trie(), len(vocab.pieces)
        ids: dict[str, int] = {}
        table = np.zeros((0, len(langs)))
        for batch in batches:
            texts = batch["text"]
            name, score = [], []
            for part in chunks(pa.compute.utf8_length(texts).fill_null(0).to_pylist()):
                own = [t if t and langs and _letter(t) else None for t in texts[part].to_pylist()]
                split = [units_of(t.lower()) if t else [] for t in own]
                if len(ids) > CACHE:
                    ids, table = {}, table[:0]
                flat = [u for s in split for u in s]
                new = [u for u in dict.fromkeys(flat) if u not in ids]
                for some in chunks([len(u) for u in new], 300_000):
                    spelt: dict[str, int] = {}
                    lat = Lattices(new[some], trie, size, spelt)
                    mass = lat.suffix_mass(spell(log_p, spelt, vocab.byte_ids))[lat.first[:-1]]
                    ids.update(zip(new[some], range(len(ids), len(ids) + len(mass)), strict=True))
                    table = np.concatenate([table, mass])
                at = np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat))
                ends = np.cumsum([0] + [len(s) for s in split])
                sums = np.concatenate([np.zeros((1, len(langs))), np.cumsum(table[at], axis=0)])
                total = sums[ends[1:]] - sums[ends[:-1]]
                for t, row in zip(own, total, strict=True):
                    best = int(row.argmax()) if t else 0
                    name.append(langs[best] if t else "und")
                    score.append(float(1 / np.exp(row - row[best]).sum()) if t else 0.0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(name, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, pieces: str = PIECES, sample: int = SAMPLE) -> DataFrame:
    vocab = Vocabulary.load(pieces)
    langs, log_p = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), vocab, sample)
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(predictor(vocab, langs, log_p), "doc_id long, held_out boolean, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
