"""Chat logs: active path, turn pairs, compaction cut, server-sent events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paging import chain


def turn_pairs(rows: DataFrame, conv: str, turn: str, role: str) -> DataFrame:
    """Rows with the roles before and after, and whether the order of roles is broken here."""
    by = Window.partitionBy(conv).orderBy(turn)
    out = rows.withColumn("before", F.lag(role).over(by)).withColumn("after", F.lead(role).over(by))
    return out.withColumn("broken", (F.col(role) == "assistant") & F.coalesce(F.col("before") != "user", F.lit(True)))


def estimated_tokens(text: Column) -> Column:
    """A token for every four characters, rounded up."""
    return F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def compaction_cut(rows: DataFrame, conv: str, turn: str, tokens: Column, keep: int) -> DataFrame:
    """Per conversation the first turn that is kept when the latest are kept up to a budget."""
    by = Window.partitionBy(conv).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_tokens", tokens).withColumn("_suffix", F.sum("_tokens").over(by))
    kept = F.col("_suffix") <= keep
    return summed.groupBy(conv).agg(F.count("*").alias("turns"), F.min(F.when(kept, F.col(turn))).alias("first_kept"), F.coalesce(F.sum(F.when(kept, F.col("_tokens"))), F.lit(0)).alias("kept_tokens"), F.sum("_tokens").alias("all_tokens"))


def active_path(entries: DataFrame, session: str) -> DataFrame:
    """Entries (session, id, parent_id, depth) from each session's last one up to its root, by parent pointers.

    Walks all sessions at once, by pointers of doubling length.
    """
    leaf = entries.groupBy(session).agg(F.max_by("id", "ord").alias("at"))
    links = entries.where("parent_id IS NOT NULL").select(session, F.col("id").alias("at"), F.col("parent_id").alias("to"))
    path = chain(leaf, links, session).withColumnRenamed("at", "id")
    return entries.select(session, "id", "parent_id").join(path, [session, "id"])


def graph_faults(entries: DataFrame, session: str) -> DataFrame:
    """Sessions whose log is damaged: no single first root, repeated ids, parents that don't come before."""
    parent = entries.select(F.col(session), F.col("id").alias("parent_id"), F.col("ord").alias("parent_ord"))
    seen = entries.join(parent.groupBy(session, "parent_id").agg(F.min("parent_ord").alias("parent_ord")), [session, "parent_id"], "left")
    bad = F.col("parent_id").isNotNull() & (F.col("parent_ord").isNull() | (F.col("parent_ord") >= F.col("ord")))
    out = seen.groupBy(session).agg(
        F.count_if(F.col("parent_id").isNull()).alias("roots"), F.count_if(bad).alias("bad_parents"), F.count("*").alias("_n"),
        F.countDistinct("id").alias("_ids"), F.min("ord").alias("_first"), F.min(F.when(F.col("parent_id").isNull(), F.col("ord"))).alias("_root"),
    )
    return out.select(session, "roots", "bad_parents", (F.col("_n") - F.col("_ids")).alias("repeated_ids"), ((F.col("roots") == 1) & (F.col("_first") == F.col("_root")) & (F.col("bad_parents") == 0) & (F.col("_n") == F.col("_ids"))).alias("whole"))


def sse_events(body: Column) -> Column:
    """`data` of each event of a server-sent stream, lines of one event joined; comments and empty events dropped."""
    blocks = F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n\n+")
    data = F.transform(blocks, lambda b: F.array_join(F.transform(F.filter(F.split(b, "\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n"))
    return F.filter(data, lambda x: x != "")
