"""Small helpers that several corpus operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import durable, written

__all__ = ["bounded", "compact", "components", "documents", "durable", "fresh", "held_out", "written"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names for `wanted` that clash with nothing in `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: str = "doc_id"):
    """True for the third of the documents that no classifier may learn from."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(3)) == 1


#: Ids that a broadcast may hold; beyond it the same join is shuffled.
BROADCAST_IDS = 400_000


#: Rows of a partition of small tables between jobs.
ROWS_A_PARTITION = 100_000


def compact(df: DataFrame) -> DataFrame:
    """`df` durable, in no more partitions than its rows need: the next shuffle then has fewer files."""
    out = durable(df)
    return out.coalesce(1 + out.count() // ROWS_A_PARTITION)


def bounded(ids: DataFrame) -> DataFrame:
    """`ids`, durable, and to be broadcast if their count shows that they are few."""
    ids = durable(ids)
    n = ids.count()
    return F.broadcast(ids.coalesce(1 + n // ROWS_A_PARTITION)) if n <= BROADCAST_IDS else ids


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that links (a, b) connect each node to.

    Alternates large and small stars until the stars stand still; every step is
    a grouped minimum and a join, and is written before the next.
    """
    stars, seen = compact(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()), None
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    while True:
        # one exchange each for the large star, the small star and for dropping repeats
        both = stars.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.*").repartition("u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(pair("v", "m"), pair("u", "m"))).alias("e")).select("e.*")
        stars = durable(small.where("u != v").distinct())
        now = stars.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**31)))).first()
        stars = stars.coalesce(1 + now[0] // ROWS_A_PARTITION)
        if now == seen:
            break
        seen = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label"))
