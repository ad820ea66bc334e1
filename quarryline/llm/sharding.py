"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions.

A row's key is hashed onto a ring that is cut into `2**ring_bits` cells. Every
shard owns `vnodes` cells; a row's home is the first owned cell clockwise. No
shard takes more than its capacity: the keys of a cell that find their shard
full continue clockwise to the next shard with room. Because keys move in
whole runs of a cell's order, the plan needs only the row counts of the cells,
a table bounded by the ring and not by the data, and each run carries its
first slot, so that slots are gapless without another shuffle.

With `load=1` the capacities add up to the number of rows and differ by one at
most (the law `rows`); a larger load leaves slack and moves fewer keys.

Defined results: a null key is placed by the hash of its payload columns;
repeated rows get slots of their own; ties inside a cell go by hash, key and
payload; an empty table yields no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, fresh

SHARDS, VNODES, RING_BITS = 40, 64, 14


def ring(spark: SparkSession, shards: int, vnodes: int, bits: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise; of two in one cell the lower shard stays."""
    points = (
        spark.range(shards * vnodes, numPartitions=1)
        .select((F.col("id") % shards).alias("shard"), cell_of(F.xxhash64(F.lit("vnode"), (F.col("id") % shards), F.floor(F.col("id") / shards)), bits).alias("cell"))
        .groupBy("cell").agg(F.min("shard").alias("shard"))
    )
    return sorted((r["cell"], r["shard"]) for r in points.collect())


def cell_of(h, bits: int):
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def capacities(rows: int, shards: int, load: float) -> list[int]:
    if load > 1:
        return [math.ceil(load * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place(counts: dict[int, int], nodes: list[tuple[int, int]], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (cell, first rank, end rank, shard, first slot) that bound every load.

    First every cell fills its own shard, clockwise; then what overflowed goes on.
    """
    cells, room, used, runs, over = [c for c, _ in nodes], list(caps), [0] * len(caps), [], []
    ahead = list(range(len(nodes)))

    def take(node: int, cell: int, lo: int, hi: int) -> int:
        shard = nodes[node][1]
        n = min(hi - lo, room[shard])
        if n:
            runs.append((cell, lo, lo + n, shard, used[shard]))
            used[shard] += n
            room[shard] -= n
        return lo + n

    def with_room(node: int) -> int:
        seen = []
        while not room[nodes[node][1]]:
            seen.append(node)
            node = ahead[node] if ahead[node] != node else (node + 1) % len(nodes)
        for x in seen:
            ahead[x] = node
        return node

    for cell in sorted(counts):
        home = bisect_left(cells, cell) % len(nodes)
        lo = take(home, cell, 0, counts[cell])
        if lo < counts[cell]:
            over.append((home, cell, lo))
    for home, cell, lo in over:
        while lo < counts[cell]:
            home = with_room(home)
            lo = take(home, cell, lo, counts[cell])
    return runs


def assign(df: DataFrame, key: str, payload: list[str], shards: int = SHARDS, vnodes: int = VNODES, load: float = 1.0, ring_bits: int = RING_BITS) -> DataFrame:
    """`key`, `payload` and `shard`, `slot` (with underscores in front where `df` has such columns) for every row of `df`."""
    if shards < 1 or vnodes < 1 or not shards <= 2**ring_bits:
        raise ValueError("a ring needs at least one cell for every shard")
    spark = df.sparkSession
    h, cell, rank, at, lo, hi, shard, slot = fresh(df.select(key, *payload), "ring_hash", "ring_cell", "ring_rank", "run_cell", "run_lo", "run_hi", "shard", "slot")
    placed = df.select(key, *payload).withColumn(h, F.when(F.col(key).isNotNull(), F.xxhash64(F.lit("key"), key)).otherwise(F.xxhash64(F.lit("row"), *payload)))
    placed = placed.withColumn(cell, cell_of(F.col(h), ring_bits))
    counts = {r[0]: r[1] for r in placed.groupBy(cell).count().collect()}  # at most 2**ring_bits rows
    nodes = ring(spark, shards, vnodes, ring_bits)
    owners = {s for _, s in nodes}
    nodes = sorted(nodes + [(c, s) for s, c in zip((s for s in range(shards) if s not in owners), (c for c in range(2**ring_bits) if c not in dict(nodes)), strict=False)])
    runs = spark.createDataFrame(place(counts, nodes, capacities(sum(counts.values()), shards, load)), f"{at} int, {lo} long, {hi} long, {shard} int, {slot} long")
    by_cell = Window.partitionBy(cell).orderBy(h, key, *payload)
    return (
        placed.withColumn(rank, F.row_number().over(by_cell) - F.lit(1))
        .join(F.broadcast(runs), (F.col(cell) == F.col(at)) & (F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi)))
        .select(key, *payload, shard, (F.col(slot) + F.col(rank) - F.col(lo)).alias(slot))
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    out = assign(docs, "doc_id", ["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per shard of op8 its documents, its first and last slot and how many different ones."""
    placed = op8_sharding(spark, sf_dir)
    return placed.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.countDistinct("slot").alias("slots"))
