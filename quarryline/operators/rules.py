"""Saved-search rules and work-item queues as predicates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import java_pattern

#: The queues, the axes' first states.
QUEUES = ("archive", "applied", "inbox", "new_inbox", "review_inbox", "interested", "preparation")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def rule(c: Column, kind: str, value: str, exclude: bool) -> Column:
    """A text rule ignores case; a regex rule minds it when it includes, and not when it excludes."""
    if kind == "text":
        return F.contains(F.lower(c), F.lower(F.lit(value)))
    return c.rlike(("(?iu)" if exclude else "") + java_pattern(value))


def title_matches(c: Column, include: list[tuple[str, str]], exclude: list[tuple[str, str]] = ()) -> Column:
    """Any include and no exclude; nothing matches without includes."""
    return any_of([rule(c, k, v, False) for k, v in include]) & ~any_of([rule(c, k, v, True) for k, v in exclude])


def matching_rules(items: DataFrame, title: str, rules: DataFrame) -> DataFrame:
    """Items that some include row and no exclude row of `rules` (effect, needle) hits.

    The rules are a saved search's, bounded by its form; they are broadcast.
    """
    hit = F.contains(F.lower(F.col(title)), F.lower(F.col("needle")))
    yes = F.broadcast(rules.where("effect = 'include'").select("needle"))
    no = F.broadcast(rules.where("effect = 'exclude'").select("needle"))
    return items.join(yes, hit, "left_semi").join(no, hit, "left_anti")


def queue_predicates(read: Column, interest: Column, preparation: Column, application: Column) -> dict[str, Column]:
    archived = interest == "dismissed"
    applied = application == "applied"
    inbox = ~archived & ~applied & (interest == "undecided")
    return {
        "archive": archived,
        "applied": ~archived & applied,
        "inbox": inbox,
        "new_inbox": inbox & (read == "unread"),
        "review_inbox": inbox & (read != "unread"),
        "interested": (interest == "interested") & ~applied & (preparation == "none"),
        "preparation": (interest == "interested") & ~applied & (preparation != "none"),
    }


def primary_queue(read: Column, interest: Column, preparation: Column, application: Column) -> Column:
    """The one queue of an item, by precedence."""
    q = queue_predicates(read, interest, preparation, application)
    return F.when(q["archive"], "archive").when(q["applied"], "applied").when(q["inbox"], "inbox").when(preparation != "none", "preparation").otherwise("interested")


def queue_counts(items: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """All items and each queue's, in one pass; 0 where there are none."""
    return items.agg(F.count("*").alias("all_items"), *[F.count_if(p).alias(k) for k, p in predicates.items()])


def facet_counts(items: DataFrame, facets: dict[str, tuple[str, list]]) -> DataFrame:
    """(facet, value, n) with a row for every value of every enum, also where n is 0."""
    cells = [(name, v, F.count_if(F.col(column) == v)) for name, (column, values) in facets.items() for v in values]
    counted = items.agg(*[n.alias(f"c{i}") for i, (_, _, n) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(name).alias("facet"), F.lit(str(v)).alias("value"), F.col(f"c{i}").alias("n")) for i, (name, v, _) in enumerate(cells)])
    return counted.select(F.inline(rows))


def search_text(columns: list[str], needle: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lower(F.lit(needle)))


def row_health(own: Column, dependency: Column) -> Column:
    return F.when(own > 0, "invalid").when(dependency > 0, "dependency_warning").otherwise("valid")


def attention_group(issues: Column, missing: Column, last_status: Column, status: Column) -> Column:
    return F.when((issues > 0) | (missing > 0) | last_status.isin("failed", "error"), "attention").otherwise(status)


def progress(states: list[Column], done: str = "done", out_of_scope: str = "not_applicable") -> tuple[Column, Column]:
    """(completed, applicable) counts of steps."""
    count = lambda test: sum((F.coalesce(test(s), F.lit(False)).cast("int") for s in states), F.lit(0))
    return count(lambda s: s == done), count(lambda s: s != out_of_scope)


def hint_prefilter(title: Column, hint: Column, authorised: Column, title_ok: Callable[[Column], Column]) -> Column:
    """Whether a candidate goes on: one without a title may be dropped by its title hint, if that is allowed to filter."""
    absent = F.coalesce(F.length(F.trim(title)), F.lit(0)) == 0
    return ~(absent & F.coalesce(authorised, F.lit(False)) & hint.isNotNull()) | F.coalesce(title_ok(hint), F.lit(False))
