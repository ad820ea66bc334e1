"""Ids and running counts over many ranges, with and without coalescing of partitions."""

import pytest
from pyspark.sql import functions as F

from quarryline.operators import catalog, resolve


@pytest.fixture(params=[True, False], ids=["coalesced", "as planned"])
def ranges(spark, request):
    names = {"spark.sql.adaptive.coalescePartitions.enabled": str(request.param).lower(), "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


N = 1_000_000


def test_ids_follow_the_order_without_gaps(ranges):
    rows = ranges.range(N).select(((F.col("id") * 7919 + 13) % N).alias("ord"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    out = catalog.with_ids(rows, "ord", 5)
    assert out.columns == ["ord", "payload", "id"]
    assert out.agg(F.count("*"), F.count_if(F.col("id") != F.col("ord") + 6)).first() == (N, 0)


def test_running_counts_keep_every_row(ranges):
    rows = ranges.range(N).select(((F.col("id") * 7919 + 13) % N).alias("ord"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    out = resolve.ranked(rows, "ord", F.col("ord") % 3 == 0, "used")
    assert out.agg(F.count("*"), F.count_if(F.col("used") != F.floor(F.col("ord") / 3) + 1)).first() == (N, 0)
