"""Corpus pipeline: from raw documents to sampled piece encodings of clean ones.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of `documents`. Between stages the rows are written as
Parquet in the shared folder and read again, so that a lost executor costs no
more than the stage at work. What a stage wrote for itself is removed when its
result is written, and its input too; the last input stays for the last stage.

Documents are told apart by near_dedup.with_nodes: rows of a null doc_id, and
several texts of one doc_id, are documents of their own. Empty tables pass
through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import decontamination, near_dedup, quality, sampled_pieces, secrets
from quarryline.llm.shared import bounded, documents, durable
from quarryline.sources.tables import remove, scratch


def without(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """`docs` but for the documents whose number is in `nodes` (one column)."""
    keyed, key = near_dedup.with_nodes(docs)
    return keyed.join(bounded(nodes.toDF(key).distinct()), key, "left_anti").select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored, (score, *_) = quality.score(docs, model)
    return scored.where(F.col(score) >= quality.KEEP).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates; of repeated rows one."""
    found = durable(near_dedup.classes(docs))
    first = without(docs, found.where("node != class_id").select("node"))
    again = durable(found.groupBy("node").count().where("count > 1").select("node"))
    if again.isEmpty():
        return first
    keyed, key = near_dedup.with_nodes(docs)
    again = bounded(again.toDF(key))
    kept = keyed.join(bounded(found.where("node = class_id").select(F.col("node").alias(key)).distinct()), key, "left_semi")
    one = kept.join(again, key, "left_semi").dropDuplicates([key])
    return kept.join(again, key, "left_anti").unionByName(one).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    keyed, key = near_dedup.with_nodes(docs)
    found = decontamination.leaks(keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.select("doc_id"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    _, ledger = secrets.scan(docs)
    return secrets.redact(docs, ledger.where(F.size("spans") > 0))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled encodings of every document, and whether they decode to its text."""
    drawn = sampled_pieces.encode(docs.select("doc_id", "text"), check=True)
    return drawn.select("doc_id", "draw", "ids", F.size("ids").cast("long").alias("n_pieces"), "log_prob", "log_inclusion", "round_trip")


STAGES = [
    ("quality classifier", good_quality),
    ("minhash near-dedup", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("sentencepiece encoding", encoded),
]

#: The stages fit a model, draw samples and walk a graph, which SQL can't express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs, path = keep(stage(spark, docs, sf_dir))
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
