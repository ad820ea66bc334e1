"""Live checks, fingerprints and detection roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def freshness(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with their state: missing, unexpected, changed or same."""
    e = expected.select(F.col(key), F.col(value).alias("expected"), F.lit(True).alias("_e"))
    a = actual.select(F.col(key), F.col(value).alias("actual"), F.lit(True).alias("_a"))
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("expected").eqNullSafe(F.col("actual")), "same").otherwise("changed")
    return e.join(a, key, "full").select(key, state.alias("state"))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def admission(documents: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of documents with one key the first is admitted, the others collide."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return documents.withColumn("admitted", rank == 1)


def live_check(rows: DataFrame, key: str, ord_: str, title: str, company: str, errors: Column) -> DataFrame:
    """Per source: candidates, acceptable ones, the first of these, and whether the check passes."""
    ok = (F.length(F.trim(title)) > 0) & (F.length(F.trim(company)) > 0)
    out = rows.groupBy(key).agg(F.count("*").alias("candidates"), F.count_if(ok).alias("acceptable"), F.min(F.when(ok, F.col(ord_))).alias("first_acceptable"), F.sum(errors.cast("long")).alias("errors"))
    return out.withColumn("passed", (F.col("errors") == 0) & (F.col("acceptable") > 0))


def detect(items: DataFrame, url: str, profiles: list[tuple[str, str]]) -> DataFrame:
    """Items with the profiles whose URL pattern they match, and the roll-up of these.

    The profiles are a registry's, held as literals; each row is scanned once.
    """
    hits = F.filter(F.array(*[F.when(F.col(url).rlike(p), F.lit(name)) for name, p in profiles]), lambda x: x.isNotNull())
    n = F.size("profiles")
    return items.withColumn("profiles", hits).withColumn("status", F.when(n > 1, "ambiguous").when(n == 1, "matched").otherwise("unsupported"))


def roll_up(cancelled: Column, exhausted: Column, matched: Column, failed: Column, unsupported_only: Column) -> Column:
    return (
        F.when(cancelled > 0, "cancelled").when(exhausted > 0, "budget_exhausted").when(matched > 1, "ambiguous").when(matched == 1, "matched")
        .when((failed > 0) & ~unsupported_only, "failed").otherwise("unsupported")
    )


def selection(wanted: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Wanted keys: missing, failed, skipped (disabled) or resolved."""
    known = registry.select(F.col(key), "valid", "enabled", F.lit(True).alias("_known"))
    state = F.when(F.col("_known").isNull(), "missing").when(~F.col("valid"), "failed").when(~F.col("enabled"), "skipped").otherwise("resolved")
    return wanted.join(known, key, "left").select(key, state.alias("state"))


def schema_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def residue(files: DataFrame, path: str, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """(path, pattern, hits) of every pattern that a file still holds."""
    rows = F.array(*[F.struct(F.lit(n).alias("pattern"), F.regexp_count(F.col(text), F.lit(p)).alias("hits")) for n, p in patterns])
    return files.select(path, F.inline(rows)).where("hits > 0")


def residue_hits(files: DataFrame, path: str, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """(path, line, pattern, nth, token): every hit of a pattern, with its line from 1 and its number among those of its line."""
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("_at", "_line"))
    found = F.array(*[F.struct(F.lit(n).alias("pattern"), F.regexp_extract_all("_line", F.lit(p), F.lit(0)).alias("tokens")) for n, p in patterns])
    rows = lines.select("path", (F.col("_at") + 1).alias("line"), F.inline(found)).where(F.size("tokens") > 0)
    return rows.select("path", "line", "pattern", F.posexplode("tokens").alias("_nth", "token")).select("path", "line", "pattern", (F.col("_nth") + 1).alias("nth"), "token")


def residue_review(hits: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Hits that nobody has reviewed (`unclassified`), and reviewed ones that are there no more (`gone`). Empty: all is reviewed."""
    key = ["path", "line", "pattern", "nth", "token"]
    own, known = hits.select(*key).distinct(), reviewed.select(*key).distinct()
    side = lambda a, b, status: a.join(b, key, "left_anti").withColumn("status", F.lit(status))
    return side(own, known, "unclassified").unionByName(side(known, own, "gone"))


def probe(responses: DataFrame, status: str, body: str, statuses: list[int], contains: list[str], pattern: str | None = None, names: tuple[str, ...] = (), known: dict[str, str] | None = None) -> DataFrame:
    """Responses with `outcome` and the captured `names`: status, then literals, then pattern, then captures decide.

    A capture that differs from what is known of it (name -> column) is a conflict.
    """
    found = {k: text.capture(F.col(body), pattern, k) for k in names}
    lacks = F.lit(False)
    for x in contains:
        lacks = lacks | ~F.contains(body, F.lit(x))
    clash = F.lit(False)
    for k, column in (known or {}).items():
        clash = clash | F.coalesce(found[k] != F.col(column), F.lit(False))
    outcome = F.when(~F.col(status).isin(statuses), "status").when(F.col(body).isNull() | lacks, "literal")
    if pattern:
        outcome = outcome.when(~F.col(body).rlike(text.java_pattern(pattern)), "pattern")
    outcome = outcome.when(clash, "conflict").otherwise("matched")
    return responses.withColumn("outcome", outcome).withColumns({k: F.when(F.col("outcome") == "matched", c) for k, c in found.items()})


def best_variant(scores: DataFrame, key: str, ord_: str, variant: str, score: str) -> DataFrame:
    """Per key the variant with the largest positive score, of equal ones the first; null where none is positive."""
    best = F.max_by(F.when(F.col(score) > 0, F.col(variant)), F.struct(F.greatest(F.col(score), F.lit(0)), -F.col(ord_)))
    return scores.groupBy(key).agg(best.alias(variant))
