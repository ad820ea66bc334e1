"""The best pairs by weighted similarity, by a top-k set join without restarts.

Each body's shingles are put in one order, the rare ones first, as counted in a
fixed number of cells by their hashes. Two bodies whose first common shingle is
the p-th of the n of one of them (from 0) can't be more similar than 1 - p / n.
Rounds go down that bound: each lets every body's next shingles take part, joins
them with all shingles so far, scores the pairs not seen before, and keeps the
best k. The k-th best score prunes by the sizes of sets what is joined and scored
next, and ends the search once no pair that has not met yet can reach it. Nothing
is searched twice.

Before the first round, neighbours by size among the bodies that have the same
rarest shingle are scored, for a k-th best score to begin with.

Shingles that many bodies hold come last in every body. If a round reaches them
all the same, they are split by the bodies' sizes: only bodies of near sizes can
still be similar enough, so that they meet in classes of size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashes
from ..functions.hashes import SKETCH
from ..functions.sets import jaccard
from ..sources.tables import durable, written
from .similar import WEIGHTS, overlap, weighted

PARTS = ("body", "identifiers", "signature", "control")
#: By how much the bound of similarity falls in the first round, and how much more in each next one.
STEP, GROWTH = 0.05, 1.5
REST = sum(WEIGHTS[1:])
#: Pairs in the first lot that is scored, for each of the k, and in any lot at most; each lot is four times the one before.
LOT, MOST_LOT = 10, 20_000


def once(feats: DataFrame, kept: list[str], made: list[str]) -> DataFrame:
    """`feats` as the output of a generator, into whose columns no filter is pushed: it would compute them again."""
    return feats.select(*kept, F.inline(F.array(F.struct(*made))))


def counted(feats: DataFrame) -> np.ndarray:
    """How many shingles of all bodies are in each cell of hashes."""
    found = once(feats, [], ["body"]).select(F.explode("body").alias("x")).groupBy(hashes.cell(F.col("x")).alias("cell")).count().toArrow()
    counts = np.zeros(1 << hashes.CELL_BITS, np.int32)
    counts[found["cell"].to_numpy()] = found["count"].to_numpy().clip(max=2**31 - 1)
    return counts


def upto(n: Column, bound: float) -> Column:
    """How many of n shingles take part at a bound."""
    return F.least(n, F.floor((1 - bound) * n + 1e-9).cast("int") + 1)


def ordered(feats: DataFrame, id_: str, counts: np.ndarray, bound: float = 0.0) -> DataFrame:
    """(rep, n, rarest, shingles, sizes): bodies in one order of all shingles, the rare ones first, as far as they take part
    down to `bound`; the rarest one that may be shared; and the sizes of all parts with their sketches. Any order gives the
    same pairs; no shingle is shuffled for this one."""
    total = F.aggregate("control", F.lit(0).cast("long"), lambda acc, n: acc + n)
    sizes = F.concat(F.array(*[F.size(c).cast("long") for c in PARTS[:3]], total), "sketch").alias("sizes")
    n = F.size("body")
    rows = feats.where(n > 0).select(F.col(id_).alias("rep"), n.alias("n"), sizes, "body", upto(n, bound).cast("int").alias("first"))
    return hashes.by_rarity(rows, "body", "first", counts)


def most(a: Column, b: Column) -> Column:
    """The highest score that two rows' sizes and sketches allow."""
    parts, at = [], 4
    for i, k in enumerate(SKETCH):
        apart = sum((F.bit_count(a[at + j].bitwiseXOR(b[at + j])) for j in range(k)), F.lit(0))
        both = F.least(a[i], b[i], F.floor((a[i] + b[i] - apart) / 2))
        parts.append(F.when(a[i] + b[i] == 0, 1.0).otherwise(both / (a[i] + b[i] - both)))
        at += k
    parts.append(F.when(F.greatest(a[3], b[3]) == 0, 1.0).otherwise(F.least(a[3], b[3]) / F.greatest(a[3], b[3])))
    # the formula of the scores, so that no bound is rounded below its score
    return F.greatest(weighted(parts, F.lit(False)), F.when(a == b, 1.0))


def meeting(rows: DataFrame, before: float, bound: float, floor: float) -> DataFrame:
    """(a, b, most), a < b, of bodies that share one of the shingles whose bound is `bound` at least, one of them below
    `before`, and that may have the score `floor`; `most` is the highest they may have."""
    least = max((floor - REST) / WEIGHTS[0], 1e-6)
    width = math.log(1 / min(least, 0.99))
    # of two bodies the larger one's class is that of the smaller or the next
    class_ = F.floor(F.log(F.col("n").cast("double")) / width + 1e-9).cast("int")
    old = F.lit(0) if before > 1 else upto(F.col("n"), before)
    probe = rows.select("rep", "n", "sizes", class_.alias("class"), old.alias("old"), F.posexplode(F.slice("shingles", F.lit(1), upto(F.col("n"), bound))).alias("p", "x"))
    probe = probe.select("x", "class", F.struct("n", "rep", "sizes", (F.col("p") >= F.col("old")).alias("new")).alias("r"))
    small = probe.select("x", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"), F.col("r").alias("s"))
    pairs = small.join(probe, ["x", "class"]).where((F.col("s.n") < F.col("r.n")) | ((F.col("s.n") == F.col("r.n")) & (F.col("s.rep") < F.col("r.rep"))))
    pairs = pairs.where((F.col("s.new") | F.col("r.new")) & (F.col("s.n") >= (least - 1e-9) * F.col("r.n"))).withColumn("most", most(F.col("s.sizes"), F.col("r.sizes")))
    return pairs.where(F.col("most") >= floor - 1e-9).select(F.least("s.rep", "r.rep").alias("a"), F.greatest("s.rep", "r.rep").alias("b"), "most").distinct()


def neighbours(rows: DataFrame, floor: float) -> DataFrame:
    """(a, b, most), a < b, of bodies that have the same rarest shingle and are next to each other by their sizes."""
    probe = rows.select("rep", F.struct("n", "rep", "sizes").alias("r"), F.explode("rarest").alias("x"))
    pairs = probe.withColumn("s", F.lag("r").over(Window.partitionBy("x").orderBy("r"))).where("s IS NOT NULL")
    pairs = pairs.select(F.least("s.rep", "r.rep").alias("a"), F.greatest("s.rep", "r.rep").alias("b"), most(F.col("s.sizes"), F.col("r.sizes")).alias("most"))
    return pairs.where(F.col("most") >= floor - 1e-9)


def scored(pairs: DataFrame, feats: Callable[[DataFrame], DataFrame], id_: str) -> DataFrame:
    """(a, b, score, and each part's similarity) of pairs, few enough for a broadcast of their ids; `feats` makes the
    features of ids."""
    feats = written(feats(pairs.select(F.explode(F.array("a", "b")).alias(id_)).distinct()))
    side = lambda x: feats.select(F.col(id_).alias(x), F.struct(*PARTS).alias(f"f_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    parts = [jaccard(F.col(f"f_a.{c}"), F.col(f"f_b.{c}")) for c in PARTS[:3]] + [overlap(F.col("f_a.control"), F.col("f_b.control"))]
    return both.select("a", "b", weighted(parts, F.col("f_a") == F.col("f_b")).alias("score"), *[p.alias(c) for c, p in zip(PARTS, parts, strict=True)])


def before(row) -> Column:
    """Whether a pair (most, a, b) comes before the pair (-m, a, b) by falling `most`, then ids."""
    m, a, b = -row[0], F.lit(row[1]), F.lit(row[2])
    return (F.col("most") > m) | ((F.col("most") == m) & ((F.col("a") < a) | ((F.col("a") == a) & (F.col("b") < b))))


def better(pairs: DataFrame, feats: Callable[[DataFrame], DataFrame], id_: str, best: DataFrame | None, threshold: float, k: int) -> DataFrame:
    """The `k` best of `best` and of the pairs (a, b, most)."""
    n, open_ = LOT * k, pairs
    while True:
        lot = durable(open_.orderBy(F.desc("most"), "a", "b").limit(n))
        held, last = lot.agg(F.count("*"), F.max(F.struct((-F.col("most")).alias("m"), "a", "b"))).first()
        if held or best is None:
            found = scored(lot, feats, id_).where(F.col("score") >= threshold - 1e-12)
            best = durable((found if best is None else best.unionByName(found)).orderBy(F.desc("score"), "a", "b").limit(k))
        if held < n:
            return best
        open_ = pairs.where(~before(last) & ~((F.col("a") == last[1]) & (F.col("b") == last[2])))
        have, worst = best.agg(F.count("*"), F.max(F.struct((-F.col("score")).alias("m"), "a", "b"))).first()
        if have >= k:
            open_ = open_.where(before(worst))
        n = min(4 * n, MOST_LOT)


def top_pairs(feats: DataFrame, id_: str, threshold: float, k: int, of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b, score, parts) of the `k` best pairs of different rows with a score of `threshold` at least, by score, then
    ids. Bodies that share nothing score 0.45 at most, so that the threshold has to be above that.

    `feats` is computed twice, once more if there is a round below the first bound; what it is computed from should be at
    hand. `of` makes the features of the ids (few, in a column `id_`) whose pairs are scored, so that no others are made;
    without it they are picked out of `feats`."""
    if threshold <= REST:
        raise ValueError(f"a threshold above {REST} is needed: below it, pairs count that share nothing")
    of = of or (lambda ids: feats.join(F.broadcast(ids), id_, "left_semi"))
    wide = once(feats, [id_], [*PARTS, "sketch"])
    counts, reach = counted(feats), 1.0 - STEP
    rows = written(ordered(wide, id_, counts, reach))
    floor, before, step = threshold, 2.0, STEP  # nothing has met
    seen = written(neighbours(rows, floor))
    best, seen = better(seen, of, id_, None, threshold, k), seen.select("a", "b")
    while True:
        n, last = best.agg(F.count("*"), F.min("score")).first()
        floor = max(floor, last) if n >= k else floor
        least = max((floor - REST) / WEIGHTS[0], 0.0)  # the least bound that can matter ends the search
        if before <= least or before <= 0:
            return best
        bound = max(min(before, 1.0) - step, min(least, before - 1e-6), 0.0)
        if bound < reach:
            rows, reach = written(ordered(wide, id_, counts, least)), least
        pairs = written(meeting(rows, before, bound, floor).join(seen, ["a", "b"], "left_anti"))
        best = better(pairs, of, id_, best, threshold, k)
        seen = seen.unionByName(pairs.select("a", "b"))
        before, step = bound, step * GROWTH


def report(rows: DataFrame, id_: str, place: list[str], pairs: DataFrame, sets: list[str]) -> DataFrame:
    """Pairs (a, b, score, parts) for people: the left row is the one whose `place` (file, line, number) comes first; each
    part in percent; what only the left and only the right row holds of each of `sets`; ranked by score and both places."""
    own = rows.select(F.col(id_).alias("id"), F.struct(*place).alias("at"), *sets)
    side = lambda x: own.select(F.col("id").alias(x), F.struct("id", "at", *sets).alias(f"row_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    first = F.col("row_a.at") <= F.col("row_b.at")
    both = both.withColumns({"left": F.when(first, F.col("row_a")).otherwise(F.col("row_b")), "right": F.when(first, F.col("row_b")).otherwise(F.col("row_a"))})
    lacks = lambda x, y, c: F.array_join(F.sort_array(F.array_except(f"{x}.{c}", f"{y}.{c}")), " | ").alias(f"{c}_only_{x}")
    percent = lambda c: (F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) * 10000) / 100).alias(f"{c}_percent")
    return both.orderBy(F.desc("score"), "left.at", "right.at").select(
        F.col("left.id").alias("left"), F.col("right.id").alias("right"), *[percent(c) for c in ("score", *PARTS)], *[lacks(x, y, c) for c in sets for x, y in (("left", "right"), ("right", "left"))])
