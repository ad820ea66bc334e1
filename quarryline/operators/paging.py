"""Pagination and sitemap walks over stored responses.

A response table has a row for every request that a source's pages were got
by; the stop rules decide which rows a run would have read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import durable, written


def pages_read(responses: DataFrame, source: str, number: str, items: Column, total: Column | None = None, page_size: int | None = None, max_items: int | None = None) -> DataFrame:
    """Rows up to the one that stops: an empty page, the total covered, or `max_items` reached.

    `total` is the largest total seen so far; without a page size the items
    read so far are held against it.
    """
    by = Window.partitionBy(source).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    prior = Window.partitionBy(source).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    out = responses.withColumn("_items", items).withColumn("read", F.sum("_items").over(by))
    stop = F.col("_items") == 0
    if total is not None:
        seen = F.max(total).over(by)
        covered = (F.row_number().over(Window.partitionBy(source).orderBy(number)) * page_size) if page_size else F.col("read")
        stop = stop | F.coalesce(covered >= seen, F.lit(False))
    if max_items is not None:
        stop = stop | (F.col("read") >= max_items)
    out = out.withColumn("_stop", stop.cast("int"))
    out = out.withColumn("_before", F.coalesce(F.max("_stop").over(prior), F.lit(0)))
    if max_items is not None:
        out = out.withColumn("read", F.least("read", F.lit(max_items)))
    return out.where("_before = 0").drop("_items", "_stop", "_before")


def first_items(items: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    """Exactly the first n items of each key."""
    return items.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def chain(starts: DataFrame, links: DataFrame, source: str, limit: int | None = None) -> DataFrame:
    """(source, at, depth) that `links` (source, at, to) lead to from `starts` (source, at), each at its least depth.

    Every round doubles the length of the links, so that n steps take log2(n)
    rounds, each written; links that would pass the end of their chain drop
    out, and a cycle ends where it comes back.
    """
    seen = fresh = durable(starts.select(source, "at").distinct().withColumn("depth", F.lit(0)))
    jumps, reach = durable(links.select(source, "at", "to").distinct()), 1
    while limit is None or reach < limit:
        moved = seen.join(jumps, [source, "at"]).groupBy(source, F.col("to").alias("at")).agg((F.min("depth") + reach).alias("depth"))
        fresh = durable(moved.join(seen, [source, "at"], "left_anti"))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        further = jumps.select(source, F.col("at").alias("to"), F.col("to").alias("_end"))
        after = jumps.select(source, F.col("at").alias("from"), "to")
        jumps = durable(after.join(further, [source, "to"]).select(source, F.col("from").alias("at"), F.col("_end").alias("to")).distinct())
        reach *= 2
    return seen if limit is None else seen.where(F.col("depth") < limit)


def cursor_chain(responses: DataFrame, source: str, limit: int) -> DataFrame:
    """Rows (source, cursor, next_cursor, step) from the null cursor on, until none or a repeated one follows."""
    pages = responses.where("cursor IS NULL OR cursor <> ''").select(source, F.coalesce("cursor", F.lit("")).alias("at"), "cursor", "next_cursor")
    links = pages.where("next_cursor <> ''").select(source, "at", F.col("next_cursor").alias("to"))
    steps = chain(pages.where("cursor IS NULL"), links, source, limit)
    return pages.join(steps, [source, "at"]).select(source, "cursor", "next_cursor", (F.col("depth") + 1).alias("step"))


def sitemap_walk(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth) reached from the roots, each at its least depth.

    A frontier at a time, each written and held against all seen nodes, so that
    a cycle ends and no level is computed twice.
    """
    edges = written(edges.repartition("parent"))
    seen = frontier = durable(roots.select(F.col(roots.columns[0]).alias("node"), F.lit(0).alias("depth")).distinct())
    for depth in range(1, max_depth + 1):
        found = frontier.join(edges, frontier["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct()
        frontier = durable(found.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def sitemap_queue(edges: DataFrame, items: DataFrame, roots: DataFrame, max_requests: int, max_depth: int = 0, max_items: int | None = None, fan_out: int | None = None) -> DataFrame:
    """(source, node, depth, nth, before, taken): the documents that a queue per source fetches, in its order, with the
    items appended before them and from them.

    `edges` has (source, parent, place, child), `items` (source, node, n), `roots` a (source, node) each source; a root
    isn't known by its URL, so that it may come again as a child. A level at a time: the rank of a node is that of its
    parent, then its place among the children, so that every limit cuts where the queue would. The document that reaches
    `max_items` is the last one. A child beyond `fan_out` clears the queue: its parent is the last document.
    """
    end = F.lit(2**62)
    links = written(edges.select("source", "parent", "place", "child").where("child IS NOT NULL").repartition("source", "parent"))
    counts = written(items.groupBy("source", "node").agg(F.sum("n").alias("n")))
    by = Window.partitionBy("source")
    level = roots.select("source", "node", F.lit(1).cast("long").alias("rank"), *[F.lit(0).cast("long").alias(c) for c in ("visited", "taken", "pushed")])
    done = seen = None
    for depth in range(max_depth + 1):
        here = level.withColumn("nth", F.col("visited") + F.col("rank")).where(F.col("nth") <= max_requests).join(counts, ["source", "node"], "left").na.fill(0, ["n"])
        before = F.col("taken") + F.coalesce(F.sum("n").over(by.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        here = here.withColumn("before", before)
        if max_items is not None:
            here = here.where(F.col("before") < max_items)
        room = F.lit(max_items) if max_items is not None else end
        here = written(here.withColumn("last", F.col("before") + F.col("n") >= room))
        found = here.where("NOT last").select("source", F.col("node").alias("parent"), "rank", "pushed").join(links, ["source", "parent"])
        first = found.groupBy("source", "child").agg(F.min(F.struct("rank", "place")).alias("at"), F.first("pushed").alias("pushed"))
        if seen is not None:
            first = first.join(seen, ["source", "child"], "left_anti")
        new = first.withColumn("k", F.row_number().over(by.orderBy("at", "child")).cast("long")) if depth < max_depth else first.withColumn("k", F.lit(0).cast("long")).limit(0)
        new = written(new)
        over = new.where(F.col("pushed") + F.col("k") > (F.lit(fan_out) if fan_out is not None else end)).groupBy("source").agg(F.min("at.rank").alias("cut"))
        fetched = written(here.join(over, "source", "left").where(F.col("rank") <= F.coalesce("cut", end)))
        one = fetched.select("source", "node", F.lit(depth).alias("depth"), "nth", "before", F.least(F.col("n"), room - F.col("before")).alias("taken"))
        done = one if done is None else done.unionByName(one)
        after = fetched.groupBy("source").agg(F.max("nth").alias("visited"), F.max(F.col("before") + F.col("n")).alias("taken"), F.max(F.col("last") | F.col("cut").isNotNull()).alias("ended"))
        pushes = new.groupBy("source").agg(F.max(F.col("pushed") + F.col("k")).alias("pushed"))
        going = after.where("NOT ended").join(pushes, "source").select("source", "visited", "taken", "pushed")
        level = durable(new.select("source", F.col("child").alias("node"), F.col("k").alias("rank")).join(going, "source"))
        if level.isEmpty():
            break
        pushed = new.select("source", "child")
        seen = pushed if seen is None else seen.unionByName(pushed)
    return done


def overlay_query(url: Column, params: dict[str, Column]) -> Column:
    """`url` with these query parameters replaced, or appended."""
    base, fragment = F.regexp_replace(url, "#.*$", ""), F.regexp_extract(url, "(#.*)$", 1)
    path, query = F.regexp_replace(base, r"\?.*$", ""), F.regexp_extract(base, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.split_part(x, F.lit("="), F.lit(1)).isin(list(params)))
    added = F.array(*[F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in params.items()])
    return F.concat(path, F.lit("?"), F.array_join(F.concat(kept, added), "&"), fragment)
