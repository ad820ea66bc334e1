"""Sightings as a stream: re-seen postings update their rows, new ones are added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import latest


def upsert_batch(path: str):
    """foreachBatch function: the batch's latest sighting of each identity joins the table's at `path`.

    Every epoch writes a folder of its own and then is named in `_current`, so
    that a replayed epoch gives the same table.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        key, at = "identity", "seen_at"
        seen = latest(batch, key, [at], ["title"])
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        before = [e for e in range(epoch - 1, -1, -1) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch={e}/_SUCCESS"))][:1]
        if before:
            old = spark.read.parquet(f"{path}/epoch={before[0]}").select(key, at, "title", "first_seen_at")
            fresh = seen.withColumn("first_seen_at", F.col(at))
            both = old.unionByName(fresh)
            best = F.max(F.struct(at, "title")).alias("best")
            seen = both.groupBy(key).agg(best, F.min("first_seen_at").alias("first_seen_at")).select(key, f"best.{at}", "best.title", "first_seen_at")
        else:
            seen = seen.withColumn("first_seen_at", F.col(at))
        seen.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def follow(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(upsert_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind and window; a window is closed when the watermark has passed it."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), kind, "n")
