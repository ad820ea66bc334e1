"""Grouped reduction with conflict quarantine, acceptance gates and strategy policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reduce_fields(rows: DataFrame, key: list[str], fields: list[str], ord_: list[str], required: tuple[str, ...] = (), first: str | None = None) -> DataFrame:
    """One row a key: a field's one distinct value, or null and a conflict where it has several.

    A conflict in a `required` field drops the key. `first` names a column for
    the place (`ord_`) where the key was first seen. Only minima, maxima and
    counts are kept, so that a hot key is reduced before the shuffle; a
    conflict never heals.
    """
    aggs = [F.min(F.struct(*ord_)).alias("_first"), F.count("*").alias("n")]
    for f in fields:
        aggs += [F.min(f).alias(f"_lo_{f}"), F.max(f).alias(f"_hi_{f}")]
    out = rows.groupBy(*key).agg(*aggs)
    same = {f: F.col(f"_lo_{f}").eqNullSafe(F.col(f"_hi_{f}")) for f in fields}
    values = [F.when(same[f], F.col(f"_lo_{f}")).alias(f) for f in fields]
    conflicts = F.concat_ws(",", *[F.when(~same[f], F.lit(f)) for f in fields]).alias("conflicts")
    for f in required:
        out = out.where(same[f])
    return out.select(*key, "n", *values, conflicts, *([F.col("_first").alias(first)] if first else []))


def acceptance(rows: DataFrame, key: str, required: list[Column], min_results: int, text: Column | None = None, min_length: int = 0) -> DataFrame:
    """Per attempt whether its rows pass: fields present, enough rows, texts long enough."""
    whole = F.lit(True)
    for c in required:
        whole = whole & (F.coalesce(F.length(F.trim(c)), F.lit(0)) > 0)
    length = F.coalesce(F.char_length(text), F.lit(0)) if text is not None else F.lit(min_length)
    out = rows.groupBy(key).agg(F.count("*").alias("results"), F.bool_and(whole).alias("fields_ok"), F.min(length).alias("shortest"))
    return out.withColumn("accepted", F.col("fields_ok") & (F.col("results") >= min_results) & (F.col("shortest") >= min_length))


def policy_status(attempts: DataFrame, key: list[str], ord_: str, accepted: Column, policy: str, count: int = 1) -> DataFrame:
    """Per phase how its policy ends: accepted or failed, and after which attempt.

    Policies: first_accepted, all_required, at_least, collect_all.
    """
    ok = F.when(accepted, F.col(ord_))
    if policy == "at_least" and count > 1:
        by = Window.partitionBy(*key).orderBy(ord_).rowsBetween(Window.unboundedPreceding, 0)
        attempts = attempts.withColumn("_ok", F.count_if(accepted).over(by))
        stop = F.min(F.when(F.col("_ok") >= count, F.col(ord_)))
        need = count
    elif policy == "all_required":
        stop, need = F.min(F.when(~accepted, F.col(ord_))), None
    else:
        stop, need = (F.min(ok) if policy in ("first_accepted", "at_least") else F.max(ord_)), count if policy == "collect_all" else 1
    out = attempts.groupBy(*key).agg(F.count("*").alias("attempts"), F.count_if(accepted).alias("accepted"), stop.alias("stopped_at"), F.max(ord_).alias("_last"))
    done = F.col("accepted") == F.col("attempts") if need is None else F.col("accepted") >= need
    return out.select(*key, "attempts", "accepted", F.when(done, "accepted").otherwise("failed").alias("status"), F.coalesce("stopped_at", "_last").alias("stopped_at"))


def cumulative(rows: DataFrame, key: list[str], order: list, cost: Column, out: str = "spent") -> DataFrame:
    return rows.withColumn(out, F.sum(cost).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def within_budget(rows: DataFrame, key: list[str], order: list, cost: Column, budget: float) -> DataFrame:
    """Rows with `state`: done, the one that exhausts the budget, or skipped after it. Equal to the budget is within."""
    spent = cumulative(rows, key, order, cost, "spent")
    before = F.col("spent") - cost
    return spent.withColumn("state", F.when(F.col("spent") <= budget, "done").when(before <= budget, "exhausted").otherwise("skipped"))


def sampled_diagnostics(rows: DataFrame, code: str, ord_: str, n: int = 10) -> DataFrame:
    """Per code its count, the first n rows' ordinals and how many are left out.

    Each partition keeps its first n before the shuffle.
    """
    counted = rows.groupBy(code).agg(F.count("*").alias("n"))
    first = rows.withColumn("_salt", F.pmod(F.xxhash64(ord_), F.lit(64)))
    for key in ([code, "_salt"], [code]):
        first = first.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(ord_))).where(F.col("_rank") <= n)
    first = first.groupBy(code).agg(F.array_sort(F.collect_list(ord_)).alias("samples"))
    return counted.join(first, code).select(code, "n", "samples", (F.col("n") - F.size("samples")).alias("omitted"))


def overall_status(cancelled: Column, failed: Column, completed: Column) -> Column:
    return F.when(cancelled > 0, "cancelled").when((failed > 0) & (completed == 0), "failed").when(failed == 0, "completed").otherwise("completed_with_errors")


def error_text(messages: Column) -> Column:
    """First three messages; more are told by dots."""
    return F.concat(F.array_join(F.slice(messages, 1, 3), "; "), F.when(F.size(messages) > 3, "; ...").otherwise(""))


def stricter(phase: dict, strategy: dict) -> dict:
    """The acceptance rules that hold for a strategy: of each limit the stricter one, all required fields of both."""
    limits = {k: max(phase.get(k, 0), strategy.get(k, 0)) for k in ("minResults", "minDescriptionLength")}
    return limits | {"requiredFields": list(dict.fromkeys([*strategy.get("requiredFields", []), *phase.get("requiredFields", [])]))}


def two_gates(rows: DataFrame, phase: str, strategy: str, identity: str, text: str, phase_rules: dict, strategy_rules: dict) -> DataFrame:
    """Phases with how many strategies and results passed, and whether the phase is accepted.

    The first gate takes or refuses each strategy's rows as a whole, by the
    stricter rules; the second holds what is left, once per identity, against
    the phase's own rules.
    """
    rules = stricter(phase_rules, strategy_rules)
    attempt = F.struct(phase, strategy)
    gate = acceptance(rows.withColumn("_attempt", attempt), "_attempt", [F.col(f) for f in rules["requiredFields"]], rules["minResults"], F.col(text), rules["minDescriptionLength"])
    taken = gate.where("accepted").select(F.col(f"_attempt.{phase}").alias(phase), F.col(f"_attempt.{strategy}").alias(strategy))
    passed = rows.join(taken, [phase, strategy])
    per = passed.groupBy(phase, identity).agg(F.min(F.char_length(text)).alias("_shortest"), *[F.min(f).alias(f"_{f}") for f in phase_rules.get("requiredFields", [])])
    final = per.groupBy(phase).agg(F.count("*").alias("results"), F.min("_shortest").alias("_shortest"), *[F.bool_and(F.coalesce(F.length(F.trim(f"_{f}")), F.lit(0)) > 0).alias(f"_{f}") for f in phase_rules.get("requiredFields", [])])
    ok = (F.col("results") >= phase_rules.get("minResults", 0)) & (F.coalesce("_shortest", F.lit(0)) >= phase_rules.get("minDescriptionLength", 0))
    for f in phase_rules.get("requiredFields", []):
        ok = ok & F.col(f"_{f}")
    every = rows.select(phase).distinct().join(taken.groupBy(phase).agg(F.count("*").alias("strategies")), phase, "left").join(final.select(phase, "results", ok.alias("_ok")), phase, "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.select(phase, count("strategies"), count("results"), F.coalesce("_ok", F.lit(phase_rules.get("minResults", 0) <= 0)).alias("accepted"))


def location_summaries(rows: DataFrame, key: str, ord_: str, location: str, n: int = 5) -> DataFrame:
    """Per key how many different locations it has, and the first n of them in the order they were met."""
    met = rows.where(F.col(location).isNotNull()).groupBy(key, location).agg(F.min(ord_).alias("_at"))
    first = met.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("_at", location))).where(F.col("_rank") <= n)
    samples = F.transform(F.array_sort(F.collect_list(F.struct("_rank", location))), lambda x: x[location]).alias("samples")
    return met.groupBy(key).agg(F.count("*").alias("locations")).join(first.groupBy(key).agg(samples), key)
