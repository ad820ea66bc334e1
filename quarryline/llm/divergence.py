"""Source divergence audit: how far the sources of a language differ in their words, and by which words.

DuckDB counts (lang, source, term) over each split of the texts, so that a
frequent term reaches the shuffle once a split and source. Shards by hash of
lang and term then hold all counts of a term: DuckDB sums them there, keeps the
terms of enough documents, and, once Spark has added up the totals of the
groups, forms every term's shares in exact integers, the partial sums of each
pair of sources that share terms, and the shard's highest-ranking terms.

A pair's distance is the sum of |p - q| over all kept terms. Only terms that
both sources hold need their shares side by side; a term that one of them
lacks counts with that source's share of a missing term, which is the same
for all of them, so that a histogram of each source's counts is enough for the
rest. Spark merges sums, pairs and rankings.

Defined results: null text, lang and source read as ''; repeated rows are
documents of their own and doc_id isn't used; ties rank by item in UTF-8 order;
a language without kept terms gives pairs of value 0; long texts are read
whole; an empty table yields no rows; other columns don't matter.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bounded, documents, durable, written
from .words import chunks

LEAST_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Counts that a split holds before it hands them on, and a task's memory before DuckDB goes to disk.
HELD, MEMORY = 1_500_000, "300MB"
#: ASCII letters, as small ones, and all bytes of other characters; all else separates terms.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTS = "lang string, source string, term string, docs long, n long"


@contextmanager
def database() -> Iterator[duckdb.DuckDBPyConnection]:
    """A database of this task's own, whose overflow is removed with it."""
    with tempfile.TemporaryDirectory() as folder, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False}) as con:
        yield con


def sent(con: duckdb.DuckDBPyConnection, sql: str) -> Iterator[pa.RecordBatch]:
    yield from con.sql(sql).to_arrow_reader(50_000)


def split_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, docs, n), once a split for each or, of many, a few times."""
    total = "SELECT lang, source, term, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL"
    with database() as con:
        con.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, docs BIGINT, n BIGINT)")
        for batch in batches:
            for part in chunks(pa.compute.utf8_length(batch["text"]).to_pylist()):
                split = [t.encode().translate(BYTES).split() for t in batch["text"][part].to_pylist()]
                size = np.array([len(w) for w in split], np.int64)
                words = pa.table({"doc": np.repeat(np.arange(len(size)), size), "term": pa.array([w for s in split for w in s], pa.string())})
                docs = pa.table({"doc": np.arange(len(size)), "lang": batch["lang"][part], "source": batch["source"][part]})
                con.register("words", words)
                con.register("docs", docs)
                con.execute("INSERT INTO counts SELECT lang, source, term, count(*), sum(n) FROM (SELECT doc, term, count(*) AS n FROM words GROUP BY ALL) JOIN docs USING (doc) GROUP BY ALL")
                if con.execute("SELECT count(*) FROM counts").fetchall()[0][0] > HELD:
                    yield from sent(con, total)
                    con.execute("TRUNCATE counts")
        yield from sent(con, total)


def kept_counts(least: int):
    """One shard's counts -> (lang, source, term, n, first) of the terms in at least `least` documents; `first` is true once a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with database() as con:
            con.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, docs BIGINT, n BIGINT)")
            for batch in batches:
                con.register("batch", pa.table(batch))
                con.execute("INSERT INTO counts SELECT lang, source, term, docs, n FROM batch")
            yield from sent(con, f"""
WITH kept AS (SELECT lang, term, min(source) AS least FROM counts GROUP BY ALL HAVING sum(docs) >= {least}),
sums AS (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n FROM counts SEMI JOIN kept USING (lang, term) GROUP BY ALL)
SELECT lang, source, term, n, source = least AS first FROM sums JOIN kept USING (lang, term)""")  # fmt: skip

    return run


def shares(top: int):
    """One shard's kept counts, with the totals of their groups -> partial pair sums and the shard's first terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = lambda n, total: f"CAST(1 + ({SCALE}::HUGEINT * ({n} + {SMOOTHING})) // ({total} + {SMOOTHING}::HUGEINT * terms) AS BIGINT)"
        with database() as con:
            con.execute("CREATE TABLE x (lang VARCHAR, source VARCHAR, term VARCHAR, p BIGINT, z BIGINT, q BIGINT)")
            con.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, total BIGINT, terms BIGINT, lang_total BIGINT)")
            for batch in batches:
                con.register("batch", pa.table(batch))
                con.execute("INSERT INTO counts SELECT lang, source, term, n, total, terms, lang_total FROM batch")
            con.execute(f"INSERT INTO x SELECT lang, source, term, {p('n', 'total')}, {p('0', 'total')}, {p('(sum(n) OVER (PARTITION BY lang, term))', 'lang_total')} FROM counts")
            yield from sent(con, """
SELECT lang, a.source, 'pair' AS part, b.source AS item, CAST(sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(a.z - b.p) + abs(a.z - b.z)) AS BIGINT) AS value
FROM x a JOIN x b USING (lang, term) WHERE a.source < b.source GROUP BY ALL""")  # fmt: skip
            yield from sent(con, f"""
SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM x WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {top}""")  # fmt: skip

    return run


def groups_of(texts: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms, lang_total, z): sums over the kept terms of every group that occurs, and the share of
    a term that it lacks (null where its language keeps no term)."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("terms"))
    found = texts.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0)
    return found.withColumn("z", F.when(F.col("terms") > 0, 1 + F.expr(f"{SCALE * SMOOTHING}L div (total + {SMOOTHING} * terms)")))


def pair_values(groups: DataFrame, kept: DataFrame, shared: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of every source of a language and every other one."""
    # a group has as many shares as it has different counts, about the root of its total
    share = F.expr(f"CAST(1 + (CAST({SCALE} AS DECIMAL(20, 0)) * (n + {SMOOTHING})) div (total + {SMOOTHING} * terms) AS BIGINT)")
    counts = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(groups, ["lang", "source"])
    shares_of = counts.groupBy("lang", "source").agg(F.collect_list(F.struct(share.alias("p"), "times")).alias("shares"))
    rows = durable(groups.join(shares_of, ["lang", "source"], "left").select("lang", "source", "terms", "z", F.coalesce("shares", F.array().cast("array<struct<p:bigint,times:bigint>>")).alias("shares")))
    other = rows.select("lang", F.col("source").alias("item"), F.col("z").alias("item_z"), F.col("shares").alias("item_shares"))
    apart = F.abs(F.col("z") - F.col("item_z"))
    lacking = lambda held, z: F.aggregate(held, F.lit(0).cast("long"), lambda acc, x: acc + x["times"] * (F.abs(x["p"] - F.col(z)) - apart))
    rest = F.col("terms") * apart + lacking("shares", "item_z") + lacking("item_shares", "z")
    pairs = rows.join(other, "lang").where("source < item").select("lang", "source", "item", F.when(F.col("terms") > 0, rest).otherwise(0).alias("rest"))
    both = shared.groupBy("lang", "source", "item").agg(F.sum("value").alias("both"))
    value = F.col("rest") + F.coalesce("both", F.lit(0))
    sides = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return pairs.join(both, ["lang", "source", "item"], "left").select("lang", F.explode(sides).alias("side"), value.alias("value")).select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources by distance, and the `top` terms a source has more of."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = texts.mapInArrow(split_counts, COUNTS).repartition(shards, "lang", "term")
    kept = written(counted.mapInArrow(kept_counts(least), "lang string, source string, term string, n long, first boolean"))
    groups = durable(groups_of(texts, kept))
    weighed = kept.join(bounded(groups), ["lang", "source"]).select("lang", "source", "term", "n", "total", "terms", "lang_total")
    parts = durable(weighed.repartition(shards, "lang", "term").mapInArrow(shares(top), "lang string, source string, part string, item string, value long"))
    found = pair_values(groups, kept, parts.where("part = 'pair'")).unionByName(parts.where("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return found.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op12_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))
