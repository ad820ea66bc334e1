"""Terminal commit of a run: postings are associated, merged and written as whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import snapshots
from ..sources.tables import written
from .catalog import with_ids
from .link import exact_identity, first_alike, greedy_merge, keyed


def associate(incoming: DataFrame, sources: DataFrame, postings: DataFrame) -> DataFrame:
    """(ord, posting_id, how) for every incoming posting (ord, title, company, locations, source_key, kind, value).

    Exact identities win; several different ones fail the commit. Else the least
    id of a similar posting of the company; else a posting of this commit that
    came before; else a new id behind the last.
    """
    exact = exact_identity(incoming, sources, ["source_key", "kind", "value"], "ord")
    exact = exact.where(F.assert_true(F.col("status") != "conflict", F.lit("a posting has two identities")).isNull())
    exact = written(exact)
    rest = incoming.join(exact.where("status = 'new'"), "ord", "left_semi")
    sides = [keyed(x, "company", "title", "locations", id_) for x, id_ in ((rest, "ord"), (postings, "id"))]
    alike = written(first_alike(*sides).withColumnRenamed("known_ord", "posting_id"))
    fresh = rest.join(alike, "ord", "left_anti")
    clusters = greedy_merge(fresh, "company", "title", "locations", "ord")
    last = postings.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    heads = with_ids(clusters.select("cluster").distinct(), "cluster", 0).crossJoin(F.broadcast(last)).select("cluster", (F.col("last") + F.col("id")).alias("posting_id"))
    inserted = clusters.join(heads, "cluster").select("ord", "posting_id")
    return (
        exact.where("status = 'found'").select("ord", "posting_id", F.lit("exact").alias("how"))
        .unionByName(alike.select("ord", "posting_id", F.lit("similar").alias("how")))
        .unionByName(inserted.select("ord", "posting_id", F.lit("inserted").alias("how")))
    )


def commit(run_id: int, at: str, incoming: DataFrame, sources: DataFrame, postings: DataFrame) -> dict[str, DataFrame]:
    """The tables after the run: postings, sources, and the run's own matches; `commit_run` puts them in place.

    A known posting keeps title and company, its locations grow and it is last
    seen now; the first source of an inserted one is primary.
    """
    where = written(associate(incoming, sources, postings))
    seen = incoming.join(where, "ord")
    first = seen.groupBy("posting_id").agg(F.min_by(F.struct("title", "company"), "ord").alias("f"), F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct("ord", "locations")))["locations"])).alias("more"))
    old = postings.join(first, postings["id"] == first["posting_id"], "left")
    kept = old.select("id", "title", "company", F.array_distinct(F.concat("locations", F.coalesce("more", F.array().cast("array<string>")))).alias("locations"), "first_seen_at", F.when(F.col("posting_id").isNotNull(), F.lit(at)).otherwise(F.col("last_seen_at")).alias("last_seen_at"))
    added = first.join(postings.select(F.col("id").alias("posting_id")), "posting_id", "left_anti")
    added = added.select(F.col("posting_id").alias("id"), "f.title", "f.company", F.col("more").alias("locations"), F.lit(at).alias("first_seen_at"), F.lit(at).alias("last_seen_at"))
    identity = ["source_key", "kind", "value"]
    found = seen.groupBy(*identity).agg(F.min("ord").alias("ord"), F.min_by("posting_id", "ord").alias("posting_id")).join(sources.select(*identity), identity, "left_anti")
    heads = added.select(F.col("id").alias("posting_id")).join(found.groupBy("posting_id").agg(F.min("ord").alias("head")), "posting_id")
    fresh = found.join(heads, "posting_id", "left").select(*identity, "posting_id", F.coalesce(F.col("ord") == F.col("head"), F.lit(False)).alias("is_primary"))
    matches = where.select(F.lit(run_id).alias("run_id"), "posting_id").distinct()
    return {"postings": kept.unionByName(added), "sources": sources.select(*identity, "posting_id", "is_primary").unionByName(fresh), "matches": matches}


TABLES = ("postings", "sources", "matches")


def commit_run(spark: SparkSession, root: str, run_id: int, at: str, incoming: DataFrame, based_on: int | None = None) -> int:
    """Commits a run to a store of `postings`, `sources` and `matches`, all three in one step; the new version.

    If another run has committed since `based_on` (the newest, if it isn't told), it is refused and leaves nothing.
    """
    based_on = snapshots.version(spark, root) if based_on is None else based_on
    known = {t: snapshots.read(spark, root, t, based_on) for t in ("postings", "sources")}
    after = commit(run_id, at, incoming, known["sources"], known["postings"])
    return snapshots.commit(root, based_on, {"postings": after["postings"], "sources": after["sources"]}, {"matches": after["matches"]})
