"""Work-item catalogue: nested reads, violations, updates, upserts, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import RANGE, in_ranges


def hydrate(parents: DataFrame, children: DataFrame, key: str, child_key: str, fields: list[str], order: list[str], out: str) -> DataFrame:
    """Every parent with the list of its children's `fields`, in `order`; empty where it has none."""
    nested = children.groupBy(F.col(child_key).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(out))
    kind = nested.schema[out].dataType.simpleString()
    return parents.join(nested, key, "left").withColumn(out, F.coalesce(out, F.array().cast(kind)))


def primary_violations(parents: DataFrame, sources: DataFrame, key: str, source_key: str, is_primary: Column) -> DataFrame:
    """Parents that don't have exactly one primary source, with how many they have."""
    per = sources.groupBy(F.col(source_key).alias(key)).agg(F.count_if(is_primary).alias("primaries"))
    return parents.select(key).join(per, key, "left").select(key, F.coalesce("primaries", F.lit(0)).cast("long").alias("primaries")).where("primaries != 1")


def keep_ids(items: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return items.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")


def missing_keys(wanted: DataFrame, key: str, present: DataFrame, present_key: str) -> DataFrame:
    return wanted.join(present.select(F.col(present_key).alias(key)), key, "left_anti")


def latest(events: DataFrame, key: str, at: list[str], fields: list[str]) -> DataFrame:
    """Per key the fields of its latest row."""
    best = F.max(F.struct(*at, *fields)).alias("best")
    return events.groupBy(key).agg(best).select(key, *[F.col(f"best.{c}").alias(c) for c in [*at, *fields]])


def upsert(table: DataFrame, changes: DataFrame, key: list[str], update: dict[str, Column], insert: dict[str, Column]) -> DataFrame:
    """MERGE: one row a key in either table. `update` and `insert` speak of `t` and `s` columns."""
    t, s = table.alias("t"), changes.alias("s")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]
    both = t.withColumn("_t", F.lit(True)).alias("t").join(s.withColumn("_s", F.lit(True)).alias("s"), on, "full")
    def value(c: str) -> Column:
        old, new = F.col(f"t.{c}"), insert.get(c, F.col(f"s.{c}") if c in changes.columns else F.lit(None))
        return F.when(F.col("_t").isNull(), new).when(F.col("_s").isNotNull(), update.get(c, old)).otherwise(old).alias(c)
    return both.select(*[value(c) for c in table.columns])


def unique_or_raise(table: DataFrame, key: list[str]) -> DataFrame:
    """`table`, failing when two rows share a key."""
    counted = table.withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    return counted.where(F.assert_true(F.col("_n") == 1, F.lit("key is not unique")).isNull()).drop("_n")


def partial_update(table: DataFrame, changes: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """Each axis of a changed row is the new value, or the old where none is given; empty changes are refused."""
    given = changes.where(F.coalesce(*axes).isNotNull()).select(key, *[F.col(a).alias(f"new_{a}") for a in axes])
    out = table.join(given, key, "left")
    return out.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in axes else F.col(c) for c in table.columns])


def set_if_null(table: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Compare-and-set: `column` is taken from `values` only where it is null."""
    return table.join(values.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


def mark_read(table: DataFrame, ids: DataFrame, key: str, column: str, at: Column) -> DataFrame:
    """`table` with `column` set to `at` for the ids that aren't read yet; what was read before keeps its time."""
    hit = ids.select(F.col(key).alias("_id")).distinct().withColumn("_hit", F.lit(True))
    out = table.join(hit, F.col(key) == F.col("_id"), "left")
    return out.withColumn(column, F.when(F.col("_hit"), F.coalesce(column, at)).otherwise(F.col(column))).drop("_id", "_hit")


def with_ids(rows: DataFrame, ord_: str, start: Column | int, id_: str = "id") -> DataFrame:
    """Surrogate ids in insertion order behind `start`.

    Ranks are taken inside ranges of `ord_` and moved up by the counts of the
    ranges before, so that no task gets all rows.
    """
    spread = in_ranges(rows, ord_)
    sizes = spread.groupBy(RANGE).count()
    before = sizes.select(RANGE, (F.sum("count").over(Window.orderBy(RANGE)) - F.col("count")).alias("_before"))  # one row a range
    rank = F.row_number().over(Window.partitionBy(RANGE).orderBy(ord_))
    return spread.join(F.broadcast(before), RANGE).withColumn(id_, F.lit(start) + F.col("_before") + rank).drop(RANGE, "_before")


def cascade(children: DataFrame, key: str, deleted: DataFrame, deleted_key: str) -> DataFrame:
    return children.join(deleted.select(F.col(deleted_key).alias(key)), key, "left_anti")


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


def first_success(attempts: DataFrame, key: str, order: Column, ok: Column, value: str) -> DataFrame:
    """Primary source first, then the others: the first attempt that gave something."""
    return attempts.where(ok).groupBy(key).agg(F.min_by(value, order).alias(value))


def totals(rows: DataFrame, groups: list[str], sums: dict[str, Column], total: str = "TOTAL") -> DataFrame:
    """Sums by group and over all, the latter named `total`."""
    out = rows.rollup(*groups).agg(*[F.sum(c).alias(k) for k, c in sums.items()], F.grouping_id().alias("_level"))
    named = [F.when(F.col("_level").bitwiseAND(1 << (len(groups) - 1 - i)) != 0, total).otherwise(F.col(g).cast("string")).alias(g) for i, g in enumerate(groups)]
    return out.select(*named, *sums)


def page(rows: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    return rows.orderBy(*order).offset(size * number).limit(size)
