"""Duplicate groups and weighted similarity of token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashes
from ..functions.sets import jaccard
from ..sources.tables import durable, written
from .catalog import with_ids

#: Weights of body shingles, identifiers, signature shingles, control tokens.
WEIGHTS = (0.55, 0.20, 0.15, 0.10)

#: Words counted as control tokens, beside question marks, and words that are no identifiers.
CONTROL = ("if", "else", "match", "for", "while", "loop", "return", "break", "continue", "await")
IGNORED = (
    "as", "async", "await", "break", "const", "continue", "crate", "dyn", "else", "enum", "extern", "false", "fn", "for", "if", "impl", "in", "let", "loop",
    "match", "mod", "move", "mut", "pub", "ref", "return", "self", "static", "struct", "super", "trait", "true", "type", "unsafe", "use", "where", "while",
)


def shingles(toks: Column, n: int = 3) -> Column:
    """Distinct runs of n tokens; fewer tokens are one run, none are none.

    `toks` should be a plain column: it is read anew for every run.
    """
    runs = F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.array_join(F.slice(toks, i, n), " "))
    return F.array_distinct(F.when(F.size(toks) >= n, runs).when(F.size(toks) > 0, F.array(F.array_join(toks, " "))).otherwise(F.array().cast("array<string>")))


def overlap(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of two count arrays; 1 if both are empty."""
    low = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda x, y: x + y)
    high = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x, y)), F.lit(0).cast("long"), lambda x, y: x + y)
    return F.when(high == 0, 1.0).otherwise(low / high)


def weighted(parts: list[Column], same: Column) -> Column:
    total = sum((F.lit(w) * p for w, p in zip(WEIGHTS, parts, strict=True)), F.lit(0.0))
    return F.when(same, 1.0).otherwise(total)


def percent(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 10000) / 100


def duplicate_groups(rows: DataFrame, hash_: str) -> DataFrame:
    """Hashes that several rows share, numbered by count, then hash."""
    groups = rows.groupBy(hash_).agg(F.count("*").alias("duplicates")).where("duplicates > 1")
    order = F.struct((-F.col("duplicates")).alias("n"), hash_)
    return with_ids(groups.withColumn("_order", order), "_order", 0, "group_id").drop("_order")


def prefixes(sets: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """(block, side, rep, n, x): of the n elements of each set `s`, by rising frequency in the block, the first
    n - ceil(threshold * n) + 1 (prefix filter), which no pair that reaches the threshold can miss each other in."""
    parts = sets.select(*block, "side", "rep", F.explode("s").alias("x"))
    common = parts.groupBy(*block, "x").agg(F.count("*").alias("df"))
    ranked = parts.join(common, [*block, "x"]).groupBy(*block, "side", "rep").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("by_df"))
    n = F.size("by_df")
    prefix = F.slice("by_df", F.lit(1), n - F.ceil(F.lit(threshold) * n - 1e-9).cast("int") + 1)
    return ranked.select(*block, "side", "rep", n.alias("n"), F.explode(prefix).alias("p")).select(*block, "side", "rep", "n", "p.x")


def meeting(left: DataFrame, right: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """(a, b) of prefixes that share an element and whose sizes allow the threshold; a pair may come several times."""
    a, b = (probe.select(*block, "x", F.col("rep").alias(x), F.col("n").alias(f"n_{x}")) for probe, x in ((left, "a"), (right, "b")))
    return a.join(b, [*block, "x"]).where(F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - 1e-9).select("a", "b")


def candidates(reps: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """(a, b): pairs of a block whose sets `s` may reach the Jaccard threshold, met on their rarest elements alone."""
    probe = prefixes(reps.withColumn("side", F.lit(0)), block, threshold)
    return meeting(probe, probe, block, threshold).where("a < b").distinct()


def across(left: DataFrame, right: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """(a, b): a set of the left and one of the right side that may reach the Jaccard threshold.

    Both sides (block, rep, s) go by one order of their elements, that of the
    frequency in both together: with an order a side, a pair could miss each other.
    """
    probe = written(prefixes(left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))), block, threshold))
    return meeting(probe.where("side = 0"), probe.where("side = 1"), block, threshold).distinct()


def similar_pairs(rows: DataFrame, id_: str, block: list[str], sets: str, threshold: float) -> DataFrame:
    """(a, b, score): pairs in a block whose sets' Jaccard similarity reaches the threshold.

    Equal sets are one representative, so that copies don't multiply; `members`
    tells which rows each stands for.
    """
    once = written(rows.select(*block, id_, F.sort_array(sets).alias("s")))  # the sets may be costly, and are read five times below
    reps = once.where(F.size("s") > 0).groupBy(*block, "s").agg(F.min(id_).alias("rep"))
    pairs = candidates(reps, block, threshold)
    sets_a, sets_b = reps.select(F.col("rep").alias("a"), F.col("s").alias("s_a")), reps.select(F.col("rep").alias("b"), F.col("s").alias("s_b"))
    scored = pairs.join(sets_a, "a").join(sets_b, "b").select("a", "b", jaccard(F.col("s_a"), F.col("s_b")).alias("score"))
    return scored.where(F.col("score") >= threshold - 1e-12)


def members(rows: DataFrame, id_: str, key: list[str]) -> DataFrame:
    """(key, id, rep): every row with the least id among the rows of its key; nulls equal each other."""
    once = written(rows.select(*key, id_))
    reps = once.groupBy(*key).agg(F.min(id_).alias("rep"))
    r = reps.select(*[F.col(k).alias(f"_{k}") for k in key], "rep")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return once.join(r, same).select(*key, id_, "rep")


def features(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, body, identifiers, signature, control, sketch): what texts are compared by.

    Hashed word shingles of the text and of its first line, its distinct words,
    counts of control tokens, and a sketch of the three sets.
    """
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    return hashes.features(rows, id_, lowered, CONTROL, IGNORED)


def best_pairs(rows: DataFrame, id_: str, text: str, threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    """The k best pairs (a, b, score) of all rows, by score, then ids; and (id, rep) of every row.

    Rows with equal features score 1.0, so that one stands for all. What it
    stands for is put back before the pairs are ranked: of the best k pairs
    none needs more than the first k + 1 rows of a group. The best pairs of
    different features come from `topk.top_pairs`.
    """
    feats = features(rows, id_, text)
    key = F.sha2(F.to_json(F.struct("body", "identifiers", "signature", "control")), 256)
    member = written(members(feats.select(id_, key.alias("key")), id_, ["key"]).select(id_, "rep"))
    sizes = durable(member.groupBy("rep").agg(F.count("*").alias("n")))
    first = member.withColumn("_rank", F.row_number().over(Window.partitionBy("rep").orderBy(id_))).where(F.col("_rank") <= k + 1).drop("_rank")
    groups = F.broadcast(sizes.where("n > 1").orderBy("rep").limit(k).select("rep"))
    few = durable(first.join(groups, "rep"))
    equal = few.select("rep", F.col(id_).alias("a")).join(few.select("rep", F.col(id_).alias("b")), "rep").where("a < b").select("a", "b", F.lit(1.0).alias("score"))
    order = [F.desc("score"), "a", "b"]
    n = sizes.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    if n >= k:
        return equal.orderBy(*order).limit(k), member
    from .topk import top_pairs

    alone = feats.join(sizes.select(F.col("rep").alias(id_)), id_, "left_semi")
    few = lambda ids: features(rows.join(F.broadcast(ids), id_, "left_semi"), id_, text)
    top = top_pairs(alone, id_, threshold, k, few).select(F.col("a").alias("ra"), F.col("b").alias("rb"), "score")
    both = top.join(first.select(F.col("rep").alias("ra"), F.col(id_).alias("x")), "ra").join(first.select(F.col("rep").alias("rb"), F.col(id_).alias("y")), "rb")
    different = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")
    return equal.unionByName(different).orderBy(*order).limit(k), member


#: What counts as one token of code, and which of them are literals.
TOKEN, LITERAL = r'"[^"]*"|[A-Za-z_][A-Za-z0-9_]*|[0-9][0-9A-Za-z_.]*|[^\sA-Za-z0-9_"]', r'^("|[0-9])'


def normal_tokens(code: Column) -> Column:
    """Tokens of code, names that `let` binds as LOCAL_1, LOCAL_2, ... by first binding, literals as LIT."""
    names = F.array_distinct(F.regexp_extract_all(code, F.lit(r"\blet\s+(?:mut\s+)?([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))
    at = lambda t: F.array_position(names, t)
    return F.transform(F.regexp_extract_all(code, F.lit(TOKEN), F.lit(0)), lambda t: F.when(t.rlike(LITERAL), "LIT").when(at(t) > 0, F.concat(F.lit("LOCAL_"), at(t).cast("string"))).otherwise(t))


def duplicate_counts(rows: DataFrame, key: str, content: Column, excluded: Column) -> DataFrame:
    """Rows' keys with how many rows that aren't excluded share their content; 0 for the excluded."""
    held = rows.select(key, F.sha2(content, 256).alias("_sha"), F.coalesce(excluded, F.lit(False)).alias("_out"))
    many = held.where(~F.col("_out")).groupBy("_sha").agg(F.count("*").alias("_n")).where("_n > 1")
    n = F.when(F.col("_out"), 0).otherwise(F.coalesce("_n", F.lit(1)))
    return held.join(many, "_sha", "left").select(key, n.cast("long").alias("duplicate_count"))
