"""Candidate resolution: one status a candidate, with exact accounting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import RANGE, in_ranges

STATUSES = ("finalized", "rejected", "unresolved", "failed", "budget_skipped")


def absolute_url(c: Column) -> Column:
    return c.rlike(r"^(?i:https?)://[^/?#@\s]+([/?#]\S*)?$")


def resolve(candidates: DataFrame, ord_: str, title_ok: Callable[[Column], Column], geo_ok: Column, needs_places: bool, detail: DataFrame, budget: int) -> DataFrame:
    """Candidates (title, company, url, n_places) with `status`.

    `detail` (ord, d_title, d_company, d_places, d_failed) holds what a detail
    fetch gives; at most `budget` candidates may fetch. The first candidate
    that finds the budget exhausted is unresolved, those after it are skipped.
    `title_ok` tells of a title column whether the rules take it.
    """
    filled = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) > 0
    c = candidates.withColumn("_complete", filled("title") & filled("company") & absolute_url(F.col("url")) & (F.lit(not needs_places) | (F.col("n_places") > 0)))
    early = filled("title") & ~title_ok(F.col("title"))
    fetch = ~early & ~F.col("_complete") & absolute_url(F.col("url"))
    c = c.withColumn("_early", early).withColumn("_fetch", fetch)
    # the fetches' ranks: counts of earlier fetches, summed over ranges and then inside each
    c = ranked(c, ord_, F.col("_fetch"), "_used")
    cut = c.where(F.col("_fetch") & (F.col("_used") > budget)).agg(F.min(ord_).alias("_cut"))
    c = c.crossJoin(F.broadcast(cut)).join(detail, ord_, "left")
    title, company = F.coalesce(F.nullif(F.trim("title"), F.lit("")), "d_title"), F.coalesce(F.nullif(F.trim("company"), F.lit("")), "d_company")
    places = F.greatest(F.coalesce("n_places", F.lit(0)), F.coalesce("d_places", F.lit(0)))
    whole = filled(title) & filled(company) & (F.lit(not needs_places) | (places > 0))
    status = (
        F.when(F.col(ord_) > F.col("_cut"), "budget_skipped")
        .when(F.col("_early"), "rejected")
        .when(F.col("_complete"), F.when(geo_ok, "finalized").otherwise("rejected"))
        .when(~F.col("_fetch") | (F.col(ord_) == F.col("_cut")), "unresolved")
        .when(F.coalesce("d_failed", F.lit(False)), "failed")
        .when(~F.coalesce(whole, F.lit(False)), "unresolved")
        .otherwise(F.when(title_ok(title) & geo_ok, "finalized").otherwise("rejected"))
    )
    return c.withColumn("title", title).withColumn("status", status).select(*candidates.columns, "status")


def ranked(rows: DataFrame, ord_: str, flag: Column, out: str) -> DataFrame:
    """Running count of `flag` in order of `ord_`, without one task that holds all rows."""
    spread = in_ranges(rows.withColumn("_flag", flag.cast("long")), ord_)
    per = spread.groupBy(RANGE).agg(F.sum("_flag").alias("_n"))
    before = per.select(RANGE, (F.sum("_n").over(Window.orderBy(RANGE)) - F.col("_n")).alias("_before"))  # one row a range
    own = F.sum("_flag").over(Window.partitionBy(RANGE).orderBy(ord_))
    return spread.join(F.broadcast(before), RANGE).withColumn(out, F.col("_before") + own).drop(RANGE, "_before", "_flag")


def accounting(resolved: DataFrame) -> DataFrame:
    """Counts by status; processed and discovered are sums that must agree."""
    out = resolved.agg(F.count("*").alias("discovered"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return out.withColumn("processed", F.col("finalized") + F.col("rejected") + F.col("unresolved") + F.col("failed"))
