"""Record linkage: exact identity first, token similarity second, conflicts shown.

Fuzzy matches need equal company keys, so that blocking by the key loses
nothing. Inside a block the merge is greedy and depends on order. Over one row
per *distinct* (title, locations), so that repeats don't matter, a company of up
to `FOLD_ROWS` is folded in pandas; the rows of a larger one are decided in
rounds of joins (`merge_rounds`), so that no task gets a whole company.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import tokens
from ..functions.sets import containment, jaccard
from ..sources.tables import durable, written
from . import merge_rounds, similar

#: Most different rows of a company that one task folds.
FOLD_ROWS = 2_000

#: Fixed values.
CONTAINMENT, JACCARD = 0.90, 0.55


def similar_titles(a: Column, b: Column) -> Column:
    return (containment(a, b) >= CONTAINMENT) & (jaccard(a, b) >= JACCARD)


def similar_pairs(items: DataFrame, id_: str, block: list[str], toks: str) -> DataFrame:
    """Pairs (a, b, containment, jaccard) of different token sets in a block whose titles match.

    Items of one set share a representative, the least id. Candidates come from
    the prefix filter of the Jaccard threshold, not from the product of a block.
    """
    sets = written(items.select(*block, id_, F.sort_array(F.array_distinct(toks)).alias("s")))
    pairs = similar.similar_pairs(sets, id_, block, "s", JACCARD).select("a", "b", F.col("score").alias("jaccard"))
    reps = sets.groupBy(*block, "s").agg(F.min(id_).alias("rep"))
    both = pairs.join(reps.select(*block, F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(reps.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    return both.select(*block, "a", "b", containment(F.col("sa"), F.col("sb")).alias("containment"), "jaccard").where(F.col("containment") >= CONTAINMENT)


def keyed(postings: DataFrame, company: str, title: str, locations: str, ord_: str) -> DataFrame:
    """(ord, company_key, title_tokens, place_tokens) of postings."""
    own = postings.select(F.col(ord_).cast("long").alias("ord"), F.array_join(tokens(F.col(company)), " ").alias("company_key"), tokens(F.col(title)).alias("title_tokens"), F.col(locations).alias("_places"))
    places = own.select("ord", F.posexplode("_places").alias("p", "place")).select("ord", "p", tokens(F.col("place")).alias("t")).groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]).alias("place_tokens"))
    return own.drop("_places").join(places, "ord", "left").withColumn("place_tokens", F.coalesce("place_tokens", F.array().cast("array<array<string>>")))


def titles_across(new: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): titles `t` of the new and of the known rows (company_key, t, s) that go together; no pair that shares no
    prefix is ever made."""
    sides = [x.select("company_key", F.col("t").alias("rep"), "s").distinct() for x in (new, known)]
    filled, bare = [x.where(F.size("s") > 0) for x in sides], [x.where(F.size("s") == 0) for x in sides]
    pairs = similar.across(*filled, ["company_key"], JACCARD)
    sets = [x.select(F.col("rep").alias(n), F.col("s").alias(f"s_{n}")) for x, n in zip(filled, "ab", strict=True)]
    pairs = pairs.join(sets[0], "a").join(sets[1], "b").where(similar_titles(F.col("s_a"), F.col("s_b"))).select("a", "b")
    a, b = (x.select("company_key", F.col("rep").alias(n)) for x, n in zip(bare, "ab", strict=True))
    return pairs.unionByName(a.join(b, "company_key").select("a", "b"))  # one title without words a company and side


def first_alike(new: DataFrame, known: DataFrame) -> DataFrame:
    """(ord, known_ord): for rows as of `keyed` the least known one of the same company with a similar title and
    locations that go together, for those that have one.

    Of the known rows of a title only the first of each place counts, so that
    many rows of one title and company don't multiply.
    """
    numbered = lambda rows: written(rows.withColumn("s", F.sort_array(F.array_distinct("title_tokens"))).withColumn("t", F.min("ord").over(Window.partitionBy("company_key", "s"))))
    new, known = numbered(new), numbered(known)
    pairs = written(titles_across(new, known)).toDF("t", "t2")
    bare = F.size("place_tokens") == 0
    by_title = known.groupBy("t").agg(F.min("ord").alias("any"), F.min(F.when(bare, F.col("ord"))).alias("bare")).withColumnRenamed("t", "t2")
    by_place = merge_rounds.firsts(merge_rounds.place_keys(known), "t").withColumnRenamed("t", "t2")
    around = pairs.join(by_title, "t2").groupBy("t").agg(F.min("any").alias("any"), F.min("bare").alias("bare"))
    at = pairs.join(by_place, "t2").groupBy("t", "key").agg(F.min("as_whole").alias("as_whole"), F.min("at_all").alias("at_all"))
    meets = merge_rounds.place_keys(new).join(at, ["t", "key"]).groupBy("ord").agg(F.min(F.when(F.col("whole"), F.col("at_all")).otherwise(F.col("as_whole"))).alias("there"))
    first = F.when(bare, F.col("any")).otherwise(F.least("bare", "there"))
    return new.join(around, "t").join(meets, "ord", "left").select("ord", first.alias("known_ord")).where(F.col("known_ord").isNotNull())


def title_ok(a: list[str], b: list[str]) -> bool:
    x, y = set(a), set(b)
    if not x or not y:
        return not x and not y
    both = len(x & y)
    return both / min(len(x), len(y)) >= CONTAINMENT and both / len(x | y) >= JACCARD


def places_ok(a: list[list[str]], b: list[list[str]]) -> bool:
    """Either side without locations, or any pair where one token list begins the other."""
    if not a or not b:
        return True
    return any(x and y and (x[: len(y)] == y or y[: len(x)] == x) for x in a for y in b)


def greedy(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of a block in order -> the cluster (its first row's ordinal) each joins."""
    kept: list[tuple[list, list, int]] = []
    out = []
    for ord_, title, places in zip(rows["ord"], rows["title_tokens"], rows["place_tokens"], strict=True):
        title, places = list(title), [list(p) for p in places]
        found = next((k for k in kept if title_ok(k[0], title) and places_ok(k[1], places)), None)
        if found is None:
            found = (title, [], ord_)
            kept.append(found)
        for p in places:
            if p not in found[1]:
                found[1].append(p)
        out.append(found[2])
    return pd.DataFrame({"ord": rows["ord"], "cluster": out})


def greedy_merge(postings: DataFrame, company: str, title: str, locations: str, ord_: str, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(ord, cluster) for every posting: the first posting's ordinal of the cluster it joins."""
    rows = keyed(postings, company, title, locations, ord_)
    # equal rows join the same cluster as their first: only that is decided; but places without any token don't even match themselves
    wordless = (F.size("place_tokens") > 0) & ~F.exists("place_tokens", lambda p: F.size(p) > 0)
    same = ["company_key", "title_tokens", "place_tokens", "wordless"]
    rows = written(rows.withColumn("wordless", F.when(wordless, F.col("ord")).otherwise(F.lit(-1).cast("long"))))
    first = written(rows.groupBy(*same).agg(F.min("ord").alias("ord")))
    large = durable(first.groupBy("company_key").count().where(F.col("count") > fold_rows).select("company_key"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return greedy(pdf.sort_values("ord"))

    folded = first.join(large, "company_key", "left_anti").groupBy("company_key").applyInPandas(fold, "ord long, cluster long")
    if not large.isEmpty():
        many = first.join(large, "company_key", "left_semi").withColumn("s", F.sort_array(F.array_distinct("title_tokens")))
        many = written(many.select(*same, "ord", "s", F.min("ord").over(Window.partitionBy("company_key", "s")).alias("t")))
        titles = many.where("ord = t").select("company_key", "t", F.col("s").alias("title_tokens"))
        folded = folded.unionByName(merge_rounds.merge(many, similar_pairs(titles, "t", ["company_key"], "title_tokens")))
    return rows.join(first.withColumnRenamed("ord", "first_ord"), same).join(folded.withColumnRenamed("ord", "first_ord"), "first_ord").select("ord", "cluster")


def exact_identity(incoming: DataFrame, known: DataFrame, identity: list[str], ord_: str) -> DataFrame:
    """Per incoming posting the posting ids its identities are known by: new, found or conflict."""
    ends = known.groupBy(*identity).agg(F.min("posting_id").alias("posting_id"), F.max("posting_id").alias("_hi"))
    per = incoming.join(ends, identity, "left").groupBy(ord_).agg(F.min("posting_id").alias("posting_id"), F.max("_hi").alias("_hi"))
    return per.select(ord_, "posting_id", F.when(F.col("posting_id").isNull(), "new").when(F.col("posting_id") == F.col("_hi"), "found").otherwise("conflict").alias("status"))

