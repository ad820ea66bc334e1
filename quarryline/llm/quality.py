"""Quality classifier by co-training of a text view and a page-metadata view.

Two logistic classifiers see the same documents apart: one the text (shape of
its characters and words, and telling words), one the metadata (source, lang,
recorded length). Over some rounds each labels the unlabelled pool, and what it
is sure of becomes training data of the other. Both are then calibrated on
labelled rows kept aside, and the calibrated views are combined into the score
of every document.

The first fit takes about `LABELLED` labelled documents, chosen by a hash of
doc_id, out of those whose crc32(doc_id) mod 3 is not 1; this bounds what comes
to the driver. The pool is every other document of them: its features are
written once, and each round goes over all of it, counts what either view is
sure of, and takes about `PICKED` of a kind by a hash, whatever their number.
Scoring covers every text whole. A document is good if its quality label is 1
and it isn't labelled toxic. Sources and languages are hashed to `SOURCES` and
`LANGS` columns, so that none is left out.

Defined results: a null text is the empty text; null metadata is a value of its
own; rows of null labels say nothing; with no labels of either kind all score
the same, and are kept; repeated rows score alike; of several labels of one
document the worst holds; an empty table yields no rows; other columns, also
such with the names of the scores, are passed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .decontamination import plain_words
from .shared import documents, durable, fresh, held_out, written
from .words import WordHashes, chunks

LABELLED = 10_000  # labelled documents of the first fit, about
TELLING = 300  # words of the text view: those that tell good from bad best
LEAST_HELD, LEAST_ERRORS = 5, 3  # documents of the sample that hold a telling word, and standard errors it tells by, at least
ROUNDS, SURE, PICKED = 3, 0.95, 400  # of co-training; PICKED pseudo-labels of a kind, view and round
SOURCES, LANGS = 256, 64  # columns of the page view
KEEP = 0.5
RIDGE = 0.3
MARKS = b"%$#&*|@~^<>{}[]\\"


def byte_classes() -> np.ndarray:
    out = np.full(256, 7, np.int64)
    out[128:] = 6
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", MARKS)):
        out[list(chars)] = k
    return out


def shapes(texts: list[str], words: list[list[bytes]], hashes: np.ndarray) -> np.ndarray:
    """Per text: sizes, shares of character classes, word length, share of words like the one before."""
    raw = [t.encode() for t in texts]
    size = np.array([len(r) for r in raw])
    n = np.array([len(w) for w in words])
    kind = byte_classes()[np.frombuffer(b"".join(raw), np.uint8)]
    count = np.bincount(np.repeat(np.arange(len(raw)), size) * 8 + kind, minlength=8 * len(raw)).reshape(-1, 8)
    doc = np.repeat(np.arange(len(n)), n)
    again = np.zeros(len(raw))
    if len(hashes):
        again += np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1])], minlength=len(raw))
    safe, many = np.maximum(size, 1), np.maximum(n, 1)
    shares = count / safe[:, None]
    return np.column_stack([np.log1p(size), np.log1p(n), np.minimum(size / many, 40), np.sqrt(shares), np.sqrt(again / many), np.log1p(n / (1 + count[:, 4]))])


def text_rows(texts: list[str | None], known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shapes, text number and hash of each text's words)."""
    own = [t or "" for t in texts]
    words = [plain_words(t) for t in own]
    hashes = known.array([x for w in words for x in w])
    return shapes(own, words, hashes), np.repeat(np.arange(len(own)), [len(w) for w in words]), hashes


def presence(doc: np.ndarray, hashes: np.ndarray, telling: np.ndarray, n: int) -> np.ndarray:
    """(text, telling word) -> 1 where the text has it. `telling` is sorted."""
    out = np.zeros((n, len(telling)), np.float32)
    if len(telling):
        at = np.minimum(np.searchsorted(telling, hashes), len(telling) - 1)
        hit = telling[at] == hashes
        out[doc[hit], at[hit]] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-4:
            break
    return beta


def linear(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return x @ beta[:-1] + beta[-1]


@dataclass
class Model:
    """A fitted pair of views; `sure` is the weight of the combination, calibration included."""

    telling: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    text: np.ndarray
    page: np.ndarray
    calibrated: np.ndarray  # (view, (slope, constant))
    combined: np.ndarray

    def text_view(self, texts: list[str | None], known: WordHashes) -> np.ndarray:
        shape, doc, hashes = text_rows(texts, known)
        return np.column_stack([(shape - self.mean) / self.scale, presence(doc, hashes, self.telling, len(texts))])

    def scores(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        """(row, (combined, text, page)) probabilities."""
        views = [np.clip(linear(x, b), -30, 30) for x, b in ((text, self.text), (page, self.page))]
        views = [a * v + b for v, (a, b) in zip(views, self.calibrated, strict=True)]
        logits = np.column_stack([linear(np.column_stack(views), self.combined), *views])
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def columns_of(values: list, n: int) -> list[int]:
    return [xxhash.xxh3_64_intdigest("null" if v is None else f"={v}") % n for v in values]


def page_rows(source: list, lang: list, chars: list) -> np.ndarray:
    out, rows = np.zeros((len(source), SOURCES + LANGS + 1)), np.arange(len(source))
    out[rows, columns_of(source, SOURCES)] = 1
    out[rows, np.array(columns_of(lang, LANGS), np.int64) + SOURCES] = 1
    out[:, -1] = [np.log1p(max(c or 0, 0)) / 10 for c in chars]
    return out


def features(telling: np.ndarray | None = None):
    """Shapes and distinct word hashes of texts, those of `telling` words alone if given; `passed` columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            texts, passed = batch["text"], [c for c in batch.schema.names if c != "text"]
            for part in chunks(pa.compute.utf8_length(texts).fill_null(0).to_pylist()):
                shape, doc, hashes = text_rows(texts[part].to_pylist(), known)
                if telling is not None:
                    some = np.isin(hashes, telling)
                    doc, hashes = doc[some], hashes[some]
                cut = np.searchsorted(doc, np.arange(len(shape) + 1))
                words = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                cols = [*[batch[c][part] for c in passed], pa.array(list(shape), pa.list_(pa.float64())), pa.array(words, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, [*passed, "shape", "words"])

    return run


FEATURES = "source string, lang string, n_chars long, shape array<double>, words array<long>"


def views_of(rows: pa.Table | pa.RecordBatch, telling: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the page view of rows of features."""
    n = rows.num_rows
    shape = np.array(rows["shape"].to_pylist()).reshape(n, len(mean))
    doc = np.repeat(np.arange(n), pa.compute.list_value_length(rows["words"]).to_numpy(zero_copy_only=False))
    words = pa.compute.list_flatten(rows["words"]).to_numpy(zero_copy_only=False).view(np.uint64)
    text = np.column_stack([(shape - mean) / scale, presence(doc, words, telling, n)])
    return text, page_rows(*(rows[c].to_pylist() for c in ("source", "lang", "n_chars")))


def sure_of(telling: np.ndarray, mean: np.ndarray, scale: np.ndarray, betas: list[np.ndarray]):
    """Rows of the pool with what either view is sure of: 1, 0 or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for x, beta in zip(views_of(batch, telling, mean, scale), betas, strict=True):
                p = 1 / (1 + np.exp(-np.clip(linear(x, beta), -30, 30)))
                told.append(pa.array((p > 0.5).astype(np.int32), mask=np.maximum(p, 1 - p) < SURE))
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], [*batch.schema.names, "by_text", "by_page"])

    return run


def pick_words(words: np.ndarray, owner: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The words whose share among bad documents differs most from that among good ones, in standard errors.

    `words` has each document's distinct words, `owner` its place in `good`.
    """
    name, at = np.unique(words, return_inverse=True)
    pos, all_ = np.bincount(at, good[owner], len(name)), np.bincount(at, minlength=len(name))
    n_pos, n = good.sum(), len(good)
    a, b = pos / max(n_pos, 1), (all_ - pos) / max(n - n_pos, 1)
    p = all_ / max(n, 1)
    z = np.abs(a - b) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / max(n_pos, 1) + 1 / max(n - n_pos, 1)))
    z[all_ < LEAST_HELD] = 0
    best = np.argsort(-z, kind="stable")[:TELLING]
    return np.sort(name[best[z[best] > LEAST_ERRORS]])


def balanced(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A fit in which either kind weighs the same."""
    return logistic(x, y, np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)))


def train(rows: pa.Table, pool: Callable[[np.ndarray], DataFrame] | None = None) -> Model | None:
    """A model of labelled rows of features; `pool` gives the features of all unlabelled ones for the telling words."""
    y, aside = np.array(rows["good"].to_pylist(), float), np.array(rows["aside"].to_pylist(), bool)
    fit = ~aside
    if not 0 < y[fit].sum() < fit.sum():
        return None
    shape = np.array(rows["shape"].to_pylist())
    doc = np.repeat(np.arange(len(y)), pa.compute.list_value_length(rows["words"]).to_numpy())
    words = pa.compute.list_flatten(rows["words"]).to_numpy().view(np.uint64)
    telling = pick_words(words[fit[doc]], (np.cumsum(fit) - 1)[doc[fit[doc]]], y[fit])
    mean, scale = shape[fit].mean(axis=0), shape[fit].std(axis=0) + 1e-6
    views = views_of(rows, telling, mean, scale)
    taught = [[(x[fit], y[fit])] for x in views]
    betas = [balanced(*t[0]) for t in taught]
    rest = pool(telling) if pool else None
    for turn in range(ROUNDS if rest is not None else 0):
        told = rest.mapInArrow(sure_of(telling, mean, scale, betas), f"{FEATURES}, lot long, by_text int, by_page int")
        kinds = [(c, v) for c in ("by_text", "by_page") for v in (0, 1)]
        counts = told.agg(*[F.count_if(F.col(c) == v) for c, v in kinds]).first()
        lot = F.pmod(F.xxhash64("lot", F.lit(turn)), F.lit(1_000_000)) / 1_000_000
        wanted = [F.coalesce((F.col(c) == v) & (lot < min(1.0, PICKED / max(n, 1))), F.lit(False)) for (c, v), n in zip(kinds, counts, strict=True)]
        # about PICKED rows of each of the four kinds
        got = told.where(wanted[0] | wanted[1] | wanted[2] | wanted[3]).select(*[c.split()[0] for c in FEATURES.split(", ")], (wanted[0] | wanted[1]).alias("for_page"), (wanted[2] | wanted[3]).alias("for_text"), "by_text", "by_page", "lot").dropDuplicates(["lot"]).toArrow()  # repeats count once
        if got.num_rows:
            both = views_of(got, telling, mean, scale)
            for k, (use, label) in enumerate((("for_text", "by_page"), ("for_page", "by_text"))):
                at = np.array(got[use].to_pylist(), bool)
                taught[k].append((both[k][at], np.array(got[label].fill_null(0).to_pylist(), float)[at]))
        betas = [balanced(np.concatenate([x for x, _ in t]), np.concatenate([v for _, v in t])) for t in taught]
    held = aside if 0 < y[aside].sum() < aside.sum() else fit
    ones = np.ones(held.sum())
    margins = [np.clip(linear(views[k][held], betas[k]), -30, 30) for k in range(2)]
    calibrated = np.array([logistic(m[:, None], y[held], ones) for m in margins])
    both = np.column_stack([a * m + b for m, (a, b) in zip(margins, calibrated, strict=True)])
    return Model(telling, mean, scale, betas[0], betas[1], calibrated, logistic(both, y[held], ones))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, exchange: bool = True) -> Model | None:
    """A model of documents that aren't held out; without `exchange` the views are fitted on labelled ones alone."""
    good = F.when(F.coalesce("toxic", F.lit(0)) == 1, 0).otherwise(F.col("quality"))
    known = labels.select("doc_id", good.cast("int").alias("good")).where("doc_id IS NOT NULL AND good IS NOT NULL").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("good").alias("good"))
    lot = F.pmod(F.xxhash64(F.lit("quality sample"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    known = known.where(lot < min(1.0, labelled / max(known.count(), 1)))  # bounded by `labelled`
    known = F.broadcast(durable(known.select(F.col("doc_id").alias("labelled_id"), "good")))
    rows = docs.select("doc_id", "text", F.col("source").cast("string"), F.col("lang").cast("string"), F.coalesce(F.col("n_chars").cast("long"), F.length("text").cast("long")).alias("n_chars")).where(~held_out())
    aside = F.coalesce(F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(5)) == 0, F.lit(False)).alias("aside")
    mine = F.col("doc_id") == F.col("labelled_id")
    page = ["source", "lang", "n_chars", "text"]
    # one row a labelled document, however many it has
    once = rows.join(known, mine).select("doc_id", "good", aside, F.struct(*page).alias("row")).groupBy("doc_id", "good", "aside").agg(F.min_by("row", F.xxhash64("row.text", "row.source")).alias("row"))
    got = once.select("good", "aside", "row.*").mapInArrow(features(), f"good int, aside boolean, {FEATURES}").toArrow()

    def pool(telling: np.ndarray) -> DataFrame:
        rest = rows.join(known, mine, "left_anti").select(*page, F.xxhash64("doc_id", "text").alias("lot"))
        kinds = FEATURES.replace(", shape", ", lot long, shape")
        return written(rest.mapInArrow(features(telling), kinds)).select(*[c.split()[0] for c in FEATURES.split(", ")], "lot")

    return train(got, pool if exchange else None) if got.num_rows else None


def score(docs: DataFrame, model: Model | None) -> tuple[DataFrame, list[str]]:
    """`docs` with the combined, text and page probabilities of being good; their names."""
    names = fresh(docs, "score", "text_score", "page_score")
    if model is None:
        return docs.withColumns({n: F.lit(1.0) for n in names}), names
    extra = fresh(docs, "recorded_chars")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            texts, out = batch["text"], []
            for part in chunks(pa.compute.utf8_length(texts).fill_null(0).to_pylist()):
                page = page_rows(*(batch[c][part].cast(k).to_pylist() for c, k in (("source", pa.string()), ("lang", pa.string()), (extra, pa.int64()))))
                out.append(model.scores(model.text_view(texts[part].to_pylist(), known), page))
            got = np.concatenate(out) if out else np.zeros((0, 3))
            kept = [c for c in batch.schema.names if c != extra]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], *[pa.array(got[:, i]) for i in range(3)]], [*kept, *names])

    schema = StructType([*docs.schema.fields])
    for n in names:
        schema = schema.add(n, DoubleType())
    chars = F.coalesce(F.col("n_chars").cast("long"), F.length("text").cast("long"))
    return docs.withColumn(extra, chars).mapInArrow(run, schema), names


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out, (total, text, page) = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col(text).alias("text_score"), F.col(page).alias("page_score"), F.col(total).alias("score"), (F.col(total) >= KEEP).alias("keep"))
