"""Transforms, cardinalities, value expressions and predicates as column builders.

Every function takes and returns Columns made of built-in functions, so that
they stay inside code generation and filters reach the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: edges of Unicode white space.
EDGES = r"(?U)^\s+|\s+$"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def normalize_whitespace(c: Column) -> Column:
    return trim(F.regexp_replace(c, r"(?U)\s+", " "))


def url_decode(c: Column) -> Column:
    """Percent-decoded; `+` stays; null where an escape or its UTF-8 is malformed."""
    out = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(out, F.lit("�")) & ~F.contains(c, F.lit("�")) & ~F.contains(F.upper(c), F.lit("%EF%BF%BD")), None).otherwise(out)


def slug_to_title(c: Column) -> Column:
    words = F.split(normalize_whitespace(F.translate(c, "-_", "  ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), " ")


def dedupe(c: Column) -> Column:
    return F.array_distinct(c)


def to_text(c: Column) -> Column:
    return c.cast("string")


def split(c: Column, separator: str, trim_parts: bool = False, drop_empty: bool = False) -> Column:
    if not separator:
        raise ValueError("a separator must not be empty")
    out = F.split(c, re.escape(separator), -1)
    if trim_parts:
        out = F.transform(out, trim)
    return F.filter(out, lambda x: x != "") if drop_empty else out


def join(c: Column, separator: str) -> Column:
    return F.array_join(c, separator)


def java_pattern(pattern: str) -> str:
    """A linear-time pattern for Java: Unicode classes on, look-around and back-references refused."""
    if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not supported")
    return "(?U)" + re.sub(r"\(\?P?<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)


def regex_replace(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, java_pattern(pattern), re.sub(r"\$\{(\d+)\}", r"$\1", replacement))


def group_index(pattern: str, name: str) -> int:
    return re.compile(re.sub(r"\(\?<(\w+)>", r"(?P<\1>", pattern)).groupindex[name]


def capture(c: Column, pattern: str, name: str) -> Column:
    """The named group of the first match, trimmed; null if empty or absent."""
    got = trim(F.regexp_extract(c, java_pattern(pattern), group_index(pattern, name)))
    return F.when(got != "", got)


# --- cardinality: arrays to one value, with an error where several are too many ---

def let(c: Column, f) -> Column:
    """f(c), where f reads c several times and c is computed once."""
    return F.element_at(F.transform(F.array(c), f), 1)


def one(values: Column) -> Column:
    return let(values, lambda v: F.when(F.size(v) <= 1, F.try_element_at(v, F.lit(1))))


def too_many(values: Column) -> Column:
    return F.size(values) > 1


def first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


# --- value expressions ---

def leaf(values: Column) -> Column:
    """Elements normalised, and empties dropped, as sequences do."""
    return F.filter(F.transform(values, normalize_whitespace), lambda x: x.isNotNull() & (x != ""))


def first_non_empty(*parts: Column) -> Column:
    if len(parts) > 16:
        raise ValueError("at most 16 candidates")
    return F.coalesce(first(F.filter(F.array(*parts), lambda p: p != "")), F.lit(""))


def combine(separator: str, parts: list[tuple[Column, bool]]) -> tuple[Column, Column]:
    """(joined text, error): parts joined; an empty optional part is skipped, a required one is an error."""
    required = [i for i, (_, needed) in enumerate(parts) if needed]
    wrong = lambda v: F.exists(F.array(*[F.coalesce(v[i], F.lit("")) for i in required]), lambda x: x == "") if required else F.lit(False)
    given = F.array(*[p for p, _ in parts])
    return let(given, lambda v: F.when(~wrong(v), F.array_join(F.filter(v, lambda x: x != ""), separator))), wrong(given)


def template(text: str, values: dict[str, Column]) -> Column:
    """`{{name}}` replaced by columns; `{{{{` is a literal `{{`; null where a value is null."""
    parts, literal = [], ""
    for m in re.finditer(r"\{\{\{\{|\{\{([\w:.]+)\}\}|.", text, re.DOTALL):
        if m[1]:
            parts += [F.lit(literal)] * bool(literal) + [values[m[1]].cast("string")]
            literal = ""
        else:
            literal += "{{" if m[0] == "{{{{" else m[0]
    return F.concat(*parts, *[F.lit(literal)] * bool(literal or not parts))


# --- predicates ---

def non_empty(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def any_non_empty(values: Column) -> Column:
    return F.coalesce(F.exists(values, lambda x: x != ""), F.lit(False))


def matches(c: Column, pattern: str) -> Column:
    """Unanchored; the empty text never matches."""
    return (c != "") & c.rlike(java_pattern(pattern))


def same_value(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def location_key(c: Column) -> Column:
    return F.lower(normalize_whitespace(c))


def distinct_locations(values: Column) -> Column:
    """First spelling of each location, by lower-cased collapsed text."""
    kept = F.filter(values, lambda x, i: (location_key(x) != "") & ~F.exists(F.slice(values, F.lit(1), i), lambda y: location_key(y) == location_key(x)))
    return F.transform(kept, normalize_whitespace)


def summary(values: Column, n: int) -> Column:
    """First n values and how many more there are."""
    more = F.size(values) - n
    return F.concat(F.array_join(F.slice(values, 1, n), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))


def shorten(c: Column, n: int = 120) -> Column:
    return F.left(c, F.lit(n))


def json_pointer_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
