"""Cutting lineage: checkpoints and Parquet tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="quarryline-ckpt-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut, in the checkpoint folder all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    for tables in _open:
        tables.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Paths written inside each `scratch` that is open.
_open: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], tuple[DataFrame, str]]]:
    """Tables written inside are removed at the end, but for what is handed to the function that this gives: it writes a
    DataFrame, and returns it with its path. Nothing else may be read later that was made inside."""
    _open.append([])
    kept: list[str] = []

    def keep(df: DataFrame) -> tuple[DataFrame, str]:
        out = written(df)
        kept.append(_open[-1][-1])
        return out, kept[-1]

    try:
        yield keep
    finally:
        for path in _open.pop():
            if path not in kept:
                remove(spark, path)


#: Column with the number of a row's range.
RANGE = "_quarryline_range"


def in_ranges(df: DataFrame, order: str) -> DataFrame:
    """`df` by ranges of `order`, each row with its range's number in RANGE.

    It is written, since a range partitioning that is planned twice has other
    bounds the second time.
    """
    return written(df.repartitionByRange(F.col(order)).withColumn(RANGE, F.spark_partition_id()))
