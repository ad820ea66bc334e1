"""Reports and logs as files: latest JSON a key, bounded artifacts, CSV reports, appended JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Changed(RuntimeError):
    """A log isn't what its writer last saw."""


def latest_reports(reports: DataFrame, path: str, key: str) -> None:
    """One JSON report a key, in a folder of its own; keys that aren't in `reports` keep theirs."""
    reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def run_artifact(rows: DataFrame, path: str, order: list, limit: int) -> None:
    """The first `limit` rows as JSON lines: a bounded projection of a run, for people to read."""
    rows.orderBy(*order).limit(limit).write.mode("overwrite").json(path)


def csv_reports(reports: dict[str, DataFrame], path: str) -> None:
    """Each report as CSV with a header, in the folder of its name."""
    for name, rows in reports.items():
        rows.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def state_of(log: DataFrame) -> tuple[int, int]:
    """Rows of a log and a sum of their hashes, in any order."""
    h = F.pmod(F.xxhash64(F.to_json(F.struct(*sorted(log.columns)))), F.lit(2**31))
    n, total = log.agg(F.count("*"), F.coalesce(F.sum(h), F.lit(0))).first()
    return n, total


def append_lines(rows: DataFrame, path: str, seen: tuple[int, int] | None = None) -> tuple[int, int]:
    """Appends JSON lines and returns the log's new state; refuses if the log's state isn't `seen`."""
    spark = rows.sparkSession
    if seen is not None and seen[0] and state_of(spark.read.schema(rows.schema).json(path)) != seen:
        raise Changed(path)
    rows.write.mode("append").json(path)
    return state_of(spark.read.schema(rows.schema).json(path))
