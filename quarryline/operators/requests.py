"""Saved requests and their requests' bodies: validation on the driver, overlays as columns."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
MAX_RADIUS, MAX_ISSUES = 2**53 - 1, 64
CREDENTIALS = re.compile(r"(?i)^(authorization|api[_-]?key|token|password|secret|cookie)$")


def validate_request(request: dict) -> list[str]:
    """What is wrong with a saved request; nothing if it may be stored."""
    issues = []
    for kind in ("include_rules", "exclude_rules"):
        for i, r in enumerate(request.get(kind, [])):
            if r.get("kind") not in ("text", "regex") or not str(r.get("value", "")).strip():
                issues.append(f"{kind}.{i}: kind or value")
            elif r["kind"] == "regex":
                try:
                    re.compile(r["value"])
                except re.error:
                    issues.append(f"{kind}.{i}: pattern")
    radius = request.get("radius_km")
    if radius is not None and (not isinstance(radius, int) or isinstance(radius, bool) or not 0 <= radius <= MAX_RADIUS):
        issues.append("radius_km: range")
    if radius is not None and not request.get("locations"):
        issues.append("radius_km: needs locations")
    if not request.get("source_keys"):
        issues.append("source_keys: empty")
    if request.get("status", "active") not in ("active", "paused"):
        issues.append("status: unknown")
    return issues[:MAX_ISSUES]


def check_body(body: dict) -> None:
    """Refuses bodies that carry credentials; `body` is {json | text | form: ...}."""
    kind, value = next(iter(body.items())) if len(body) == 1 else (None, None)
    if kind not in ("json", "text", "form"):
        raise ValueError("a body is one of json, text, form")

    def walk(x: object) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                if CREDENTIALS.match(k):
                    raise ValueError(f"credential-like key: {k}")
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    walk(value)


def overlay_body(body: dict, params: dict[str, Column]) -> Column:
    """The JSON body with authored top-level keys replaced; texts that look like whole numbers become numbers."""
    if extra := set(params) - set(body):
        raise ValueError(f"not in the body: {sorted(extra)}")
    parts = []
    for k, v in body.items():
        text = params[k].cast("string") if k in params else None
        shown = F.lit(json.dumps(v)) if text is None else F.when(text.rlike("^(0|[1-9][0-9]*)$"), text).otherwise(F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'^\{"v":(.*)\}$', 1))
        parts.append(F.concat(F.lit(f"{json.dumps(k)}:"), shown))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def ok_status(status: Column, policy: str = "require_success") -> Column:
    return status.between(200, 299) if policy == "require_success" else F.lit(True)


def options(keys: DataFrame, known: DataFrame, key: str, name: str) -> DataFrame:
    """Source options: missing ones first, then by German collation of the name; the key stands in for a missing name."""
    out = keys.join(known.select(key, name), key, "left").withColumn("missing", F.col(name).isNull())
    out = out.withColumn(name, F.coalesce(name, F.col(key).cast("string")))
    return out.orderBy(F.desc("missing"), F.collate(name, "de"), key)


def exactly_one(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Each wanted key with how its collection matched: one, missing or multiple."""
    n = found.groupBy(key).agg(F.count("*").alias("_n"))
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") == 1, "one").otherwise("multiple")
    return wanted.join(n, key, "left").select(key, state.alias("match"))


def merge_fragments(base: DataFrame, over: DataFrame, key: str, ord_: str, fields: list[str]) -> DataFrame:
    """Base rows in their order, fields overridden by key; additions behind them."""
    o = over.select(F.col(key), F.col(ord_).alias("_o"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = base.join(o, key, "full")
    place = F.struct(F.col(ord_).isNull().alias("added"), F.coalesce(ord_, "_o").alias("at"))
    return both.select(key, place.alias("place"), *[F.coalesce(f"_{f}", f).alias(f) for f in fields])


def route(diagnostics: DataFrame, targets: list[tuple[str, DataFrame]], ids: str) -> DataFrame:
    """Diagnostics with the first target kind whose key they name; leftovers are unassigned.

    targets: (column, frame of its one key column), by precedence.
    """
    out = diagnostics
    for i, (column, known) in enumerate(targets):
        out = out.join(known.select(F.col(known.columns[0]).alias(column), F.lit(True).alias(f"_hit{i}")).distinct(), column, "left")
    kind = F.coalesce(*[F.when(F.col(f"_hit{i}"), F.lit(c)) for i, (c, _) in enumerate(targets)], F.lit("unassigned"))
    return out.select(ids, kind.alias("assigned_to"))


def provenance(rows: DataFrame, key: list[str], origin: list[str]) -> DataFrame:
    """Per key its distinct origins, sorted."""
    return rows.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct(*origin))).alias("origins"))


def reconcile(evidence: DataFrame, key: str, ord_: str, field: str, value: str) -> DataFrame:
    """Per proposal and field the agreed value; a field with two values is a conflict, told with its first row."""
    first = F.min_by(value, ord_)
    per = evidence.groupBy(key, field).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), first.alias("_first"), F.min(ord_).alias("first_at"))
    same = F.col("_lo").eqNullSafe(F.col("_hi"))
    return per.select(key, field, F.when(same, F.col("_first")).alias(value), (~same).alias("conflict"), "first_at")


def relabel(rows: DataFrame, code: str, labels: dict[str, str], fallback: str, out: str = "label") -> DataFrame:
    """Rows with the label of their code, or the fallback."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return rows.withColumn(out, F.coalesce(F.try_element_at(known, F.col(code)), F.lit(fallback)))
