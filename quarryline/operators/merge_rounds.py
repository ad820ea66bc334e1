"""The order-dependent merge of a large company's postings, decided in rounds.

`link.greedy` puts each row into the first cluster before it whose first row has
a similar title and whose locations so far go with its own. A row needs not wait
for all rows before it: only for those that could still decide its cluster. A
round decides, with joins over titles and place keys, every row for which no
open row matters any more, and is written before the next. The first open row
of a company always is one, so that rounds end; rows that are alike by title and
place follow their first row in the round after it.

Two locations go together if the tokens of one begin the other's. So a place has
a key for each of its beginnings, and two places go together just if they share
a key that is the whole of one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import durable, written


def title_graph(rows: DataFrame, similar: DataFrame) -> DataFrame:
    """(t, t2): titles that go together, in both directions, and each with itself. `similar` has pairs (a, b)."""
    sides = F.array(F.struct(F.col("a").alias("t"), F.col("b").alias("t2")), F.struct(F.col("b").alias("t"), F.col("a").alias("t2")))
    return rows.select("t", F.col("t").alias("t2")).distinct().unionByName(similar.select(F.explode(sides).alias("e")).select("e.*"))


def place_keys(rows: DataFrame) -> DataFrame:
    """(ord, t, key, whole) of every beginning of every location."""
    places = rows.select("ord", "t", F.explode("place_tokens").alias("p")).where(F.size("p") > 0)
    keys = places.select("ord", "t", F.size("p").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.struct(n.alias("k"), F.slice("p", F.lit(1), n).alias("key")))).alias("x"))
    return keys.groupBy("ord", "t", F.array_join("x.key", "\x1f").alias("key")).agg(F.max(F.col("x.k") == F.col("n")).alias("whole"))


def firsts(rows: DataFrame, *by: str) -> DataFrame:
    """The first row with a key as a whole place, and the first with it at all."""
    return rows.groupBy(*by, "key").agg(F.min(F.when(F.col("whole"), F.col("ord"))).alias("as_whole"), F.min("ord").alias("at_all"))


def decide(open_: DataFrame, done: DataFrame, rows: DataFrame, keys: DataFrame, graph: DataFrame) -> DataFrame:
    """(ord, cluster) of the open rows that nothing open can change any more."""
    placed = F.size("place_tokens") > 0
    todo = rows.join(open_, "ord").select("ord", "t", placed.alias("placed"))
    heads = rows.join(done.where("ord = cluster"), "ord").select("ord", "t", placed.alias("placed"))
    # by title: the first cluster, and the first open rows: any, without places, with places
    least = lambda kind, ok: F.min(F.when(ok, F.col("ord"))).alias(kind)
    by_title = heads.withColumn("open", F.lit(False)).unionByName(todo.withColumn("open", F.lit(True))).groupBy("t").agg(
        least("head", ~F.col("open")), least("any", F.col("open")), least("bare", F.col("open") & ~F.col("placed")), least("full", F.col("open") & F.col("placed")))
    near = graph.join(by_title.withColumnRenamed("t", "t2"), "t2")
    around = near.groupBy("t").agg(*[F.min(c).alias(c) for c in ("head", "any", "bare", "full")])

    # by title and place: clusters that hold the place, and clusters that an open row could bring it to
    members = done.join(keys.drop("t"), "ord")
    held = firsts(members, "cluster").join(heads.select(F.col("ord").alias("cluster"), F.col("t").alias("t2")), "cluster")
    held = held.select("t2", "key", "as_whole", "at_all", "cluster", F.lit(True).alias("sure"))
    to_come = firsts(keys.join(open_, "ord"), "t").withColumnRenamed("t", "t2").join(graph.toDF("t3", "t2"), "t2").groupBy("t3", "key").agg(F.min("as_whole").alias("as_whole"), F.min("at_all").alias("at_all"))
    alive = by_title.select(F.col("t").alias("t3"), F.least("head", "any").alias("cluster"))
    to_come = to_come.join(alive, "t3").select(F.col("t3").alias("t2"), "key", "as_whole", "at_all", "cluster", F.lit(False).alias("sure"))
    by_place = graph.join(held.unionByName(to_come), "t2").drop("t2")
    own = keys.join(open_, "ord")
    meets = own.join(by_place, ["t", "key"]).where((F.col("cluster") < F.col("ord")) & (F.when(F.col("whole"), F.col("at_all")).otherwise(F.col("as_whole")) < F.col("ord")))
    by_place = meets.groupBy("ord").agg(F.min(F.when(F.col("sure"), F.col("cluster"))).alias("place_yes"), F.min(F.when(~F.col("sure"), F.col("cluster"))).alias("place_maybe"))

    # clusters whose rows before have no places take any; unless an open row may bring them one
    filled = done.join(rows.where(placed).select("ord"), "ord").groupBy("cluster").agg(F.min("ord").alias("since"))
    bare = heads.where(~F.col("placed")).select(F.col("ord").alias("cluster"), F.col("t").alias("t2")).join(filled, "cluster", "left").join(around.select(F.col("t").alias("t2"), F.col("full").alias("next")), "t2", "left")
    takes = todo.where("placed").join(graph.join(bare, "t2"), "t").where((F.col("cluster") < F.col("ord")) & (F.col("since").isNull() | (F.col("since") > F.col("ord"))))
    certain = F.col("next").isNull() | (F.col("next") >= F.col("ord"))
    takes = takes.groupBy("ord").agg(F.min(F.when(certain, F.col("cluster"))).alias("bare_yes"), F.min(F.when(~certain, F.col("cluster"))).alias("bare_maybe"))

    before = lambda c: F.when(F.col(c) < F.col("ord"), F.col(c))
    end = F.lit(2**63 - 1)
    first = lambda *cs: F.least(*[F.coalesce(c, end) for c in cs])
    yes = F.when(F.col("placed"), first(F.col("place_yes"), F.col("bare_yes"))).otherwise(first(before("head"), end))
    maybe = F.when(F.col("placed"), first(before("bare"), F.col("place_maybe"), F.col("bare_maybe"))).otherwise(first(before("any"), end))
    all_ = todo.join(around, "t", "left").join(by_place, "ord", "left").join(takes, "ord", "left").select("ord", yes.alias("yes"), maybe.alias("maybe"))
    settled = all_.where((F.col("yes") <= F.col("maybe")))  # equal at the end: neither is there, and the row heads a cluster
    return settled.select("ord", F.when(F.col("yes") < end, F.col("yes")).otherwise(F.col("ord")).alias("cluster"))


def merge(rows: DataFrame, similar: DataFrame) -> DataFrame:
    """(ord, cluster) of rows (ord, t, place_tokens): `t` numbers their titles, `similar` has the pairs of titles that go together."""
    rows = written(rows.select("ord", "t", "place_tokens"))
    keys, graph = written(place_keys(rows)), written(title_graph(rows, similar))
    open_, done = durable(rows.select("ord")), durable(rows.select("ord", F.col("ord").alias("cluster")).limit(0))
    while not open_.isEmpty():
        new = durable(decide(open_, done, rows, keys, graph))
        done, open_ = durable(done.unionByName(new)), durable(open_.join(new, "ord", "left_anti"))
    return done
