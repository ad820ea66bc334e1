"""Declarative profiles: a JSON document becomes a DataFrame pipeline.

    parse -> select -> captures -> where -> extract -> reduce -> accept

Every expression is compiled to Columns once, on the driver; the rows see
built-in functions only, but for HTML and XML trees. Order is an explicit
ordinal: (document, item).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import html, text
from ..operators import reduce as grouped
from ..sources.tables import written

#: Fixed values.
PATH = re.compile(r"^\$(\.[A-Za-z0-9_]+)*$")
KEYS = {"schemaVersion", "key", "kind", "parse", "select", "match", "captures", "where", "extract", "identity", "accept"}
TRANSFORMS = {
    "trim": text.trim, "normalize_whitespace": text.normalize_whitespace, "url_decode": text.url_decode, "slug_to_title": text.slug_to_title,
    "to_string": text.to_text, "html_to_text": html.html_to_text,
}
SELECTS = {"json": {"document", "json_path"}, "xml": {"document", "xml_element", "xml_text", "sitemap_urls"}, "html": {"document", "css"}}


class Invalid(ValueError):
    """A document that the closed schema refuses."""


def only(d: dict, allowed: set[str], at: str) -> None:
    if extra := set(d) - allowed:
        raise Invalid(f"{at}: unknown keys {sorted(extra)}")


def one_of(d: dict, at: str) -> tuple[str, object]:
    if not isinstance(d, dict) or len(d) != 1:
        raise Invalid(f"{at}: exactly one expression expected")
    return next(iter(d.items()))


@dataclass
class Scope:
    """Where expressions find their values."""

    json: bool
    config: dict
    captures: dict[str, Column]
    depth: int = 0
    meta: Column | None = None  # what is known of a posting, in its detail
    paths: dict[str, Column] = field(default_factory=dict)  # texts at the paths that were read ahead
    css: dict[tuple[str, str | None], Column] = field(default_factory=dict)  # and what selectors found

    def deeper(self) -> Scope:
        if self.depth >= 16:
            raise Invalid("expressions are nested too deep")
        return replace(self, depth=self.depth + 1)

    def texts(self, path: str) -> Column:
        return self.paths[path] if path in self.paths else variant_texts(F.col("item"), path)


def gets(v: Column, path: str) -> tuple[Column, Column]:
    """What stands at a path, as an array of texts and as one text."""
    return F.try_variant_get(v, path, "array<string>"), F.try_variant_get(v, path, "string")


def variant_texts(v: Column, path: str, got: tuple[Column, Column] | None = None) -> Column:
    """Scalars at a path as an array of texts; arrays spread, objects and nulls dropped."""
    many, single = got or gets(v, path)
    # an object's text begins with a brace; only then its kind is asked for
    object_ = single.startswith("{") & F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("OBJECT")
    return F.when(many.isNotNull(), F.filter(many, lambda x: x.isNotNull())).when(single.isNull() | object_, F.array().cast("array<string>")).otherwise(F.array(single))


def reads(e: object) -> list[str]:
    """The JSON paths that expressions read, each once."""
    found: list[str] = []
    for name, arg in e.items() if isinstance(e, dict) else enumerate(e) if isinstance(e, list) else ():
        if name == "item_field":
            found.append(f"$.{arg}")
        elif name == "json_path":
            found.append(arg)
        elif name == "template":
            found += [f"$.{f}" for f in re.findall(r"\{\{item:([\w.]+)\}\}", arg)]
        else:
            found += reads(arg)
    return list(dict.fromkeys(found))


def css_of(e: dict) -> tuple[str, str | None]:
    """The selector and attribute (None for text) of a CSS expression."""
    return (e["css_text"], None) if "css_text" in e else (e["css_attribute"]["selector"], e["css_attribute"]["attribute"])


def selectors(e: object) -> list[tuple[str, str | None]]:
    """The selectors and attributes that expressions ask for, each once."""
    own = [css_of(e)] if isinstance(e, dict) and set(e) & {"css_text", "css_attribute"} else []
    inner = [x for v in (e.values() if isinstance(e, dict) else e if isinstance(e, list) else ()) for x in selectors(v)]
    return list(dict.fromkeys([*own, *inner]))


def computed(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """Rows with further columns that are computed once.

    A projection would be copied into each expression and filter that reads
    it; the output of a generator isn't.
    """
    return rows.select("*", F.inline(F.array(F.struct(*columns)))) if columns else rows


def values(e: dict, scope: Scope, at: str) -> Column:
    """An expression's values as an array of texts."""
    name, arg = one_of({k: v for k, v in e.items() if k not in ("cardinality", "transforms")}, at)
    item = F.col("item")
    if name == "const":
        return F.array(F.lit(str(arg).lower() if isinstance(arg, bool) else str(arg)))
    if name == "source_config":
        got = scope.config.get(arg)
        return F.array(*[F.lit(str(x)) for x in (got if isinstance(got, list) else [got] if got is not None else [])]).cast("array<string>")
    if name == "posting_meta":
        if scope.meta is None:
            raise Invalid(f"{at}: only details know postings")
        return F.array(F.try_element_at(scope.meta, F.lit(arg)))
    if name == "capture":
        if arg not in scope.captures:
            raise Invalid(f"{at}: unknown capture {arg}")
        return F.array(scope.captures[arg])
    if name in ("item_field", "json_path"):
        if not scope.json:
            if arg not in ("value", "."):
                raise Invalid(f"{at}: text items only have a value")
            return F.array(item)
        path = f"$.{arg}" if name == "item_field" else arg
        if not PATH.match(path):
            raise Invalid(f"{at}: path not supported: {path}")
        return scope.texts(path)
    if name == "template":
        named = {f"capture:{k}": c for k, c in scope.captures.items()} | {f"config:{k}": F.lit(str(v)) for k, v in scope.config.items()}
        fields = set(re.findall(r"\{\{item:([\w.]+)\}\}", arg))
        named |= {f"item:{f}": text.first(scope.texts(f"$.{f}") if scope.json else F.array(item)) for f in fields}
        try:
            return F.array(text.template(arg, named))
        except KeyError as k:
            raise Invalid(f"{at}: unknown name {k}") from None
    if name == "first_non_empty":
        return F.array(text.first_non_empty(*[value(x, scope.deeper(), f"{at}.{i}") for i, x in enumerate(arg)]))
    if name == "combine":
        parts = [(value(x["value"], scope.deeper(), f"{at}.{i}"), not x.get("optional", False)) for i, x in enumerate(arg["parts"])]
        return F.array(text.combine(arg.get("separator", ""), parts)[0])
    if name in ("css_text", "css_attribute"):
        selector, attribute = css_of(e)
        if (selector, attribute) in scope.css:
            return scope.css[selector, attribute]
        return html.css_text(item, selector) if attribute is None else html.css_attribute(item, selector, attribute)
    if name in ("xml_text", "xml_element"):
        return getattr(html, name)(item, arg)
    raise Invalid(f"{at}: unknown expression {name}")


def transformed(c: Column, steps: list, at: str) -> Column:
    for step in steps:
        name, arg = (step, None) if isinstance(step, str) else one_of(step, at)
        if name in TRANSFORMS:
            c = F.transform(c, TRANSFORMS[name]) if name != "html_to_text" else F.array(html.html_to_text(text.first(c)))
        elif name == "regex_replace":
            c = F.transform(c, lambda x, a=arg: text.regex_replace(x, a["pattern"], a["replacement"]))
        elif name == "split":
            c = F.flatten(F.transform(c, lambda x, a=arg: text.split(x, a["separator"], a.get("trimParts", False), a.get("dropEmpty", False))))
        elif name == "join":
            c = F.array(text.join(c, arg))
        elif name == "dedupe":
            c = text.dedupe(c)
        else:
            raise Invalid(f"{at}: unknown transform {name}")
    return c


def sequence(e: dict, scope: Scope, at: str) -> Column:
    return text.leaf(transformed(F.filter(values(e, scope, at), lambda x: x.isNotNull()), e.get("transforms", []), at))


def scalars(e: dict, scope: Scope, at: str) -> Column:
    got = transformed(F.filter(values(e, scope, at), lambda x: x.isNotNull()), e.get("transforms", []), at)
    return F.transform(got, text.normalize_whitespace)


def lists(e: dict | list, scope: Scope, at: str) -> Column:
    """A list field: one expression, or several whose values are joined; a member without any is skipped."""
    if isinstance(e, dict):
        return sequence(e, scope, at)
    members = [F.coalesce(sequence(x, scope, f"{at}.{i}"), F.array().cast("array<string>")) for i, x in enumerate(e)]
    return F.flatten(F.array(*members))


def value(e: dict, scope: Scope, at: str) -> Column:
    """A scalar: by cardinality, null where nothing is there or too much."""
    got, kind = scalars(e, scope, at), e.get("cardinality", "one")
    if kind not in ("one", "optional", "first"):
        raise Invalid(f"{at}: a scalar can't be {kind}")
    return text.first(got) if kind == "first" else text.one(got)


def condition(p: dict, scope: Scope, at: str) -> Column:
    name, arg = one_of(p, at)
    if name == "non_empty":
        return text.non_empty(value(arg, scope, at)) if arg.get("cardinality") != "all" else text.any_non_empty(sequence(arg, scope, at))
    if name == "regex":
        return F.coalesce(text.matches(value(arg["value"], scope, at), arg["pattern"]), F.lit(False))
    if name == "equal":
        return text.same_value(value(arg["left"], scope, at), value(arg["right"], scope, at))
    raise Invalid(f"{at}: unknown predicate {name}")


def check(profile: dict) -> None:
    only(profile, KEYS, "profile")
    if profile.get("schemaVersion") != 3:
        raise Invalid("profile: schemaVersion must be 3")
    kind, (select, _) = profile["parse"], one_of(profile["select"], "select")
    if kind not in SELECTS or select not in SELECTS[kind]:
        raise Invalid(f"select: {select} does not go with {kind}")


def tagged(profile: dict, docs: DataFrame) -> tuple[DataFrame, bool]:
    """(source_key, doc_ord, item_ord, item, code) by one generator, and whether items are JSON.

    A document without items gives one row, whose `code` says why: it doesn't
    parse, or its selection is empty (null for a sitemap, which may be).
    """
    select, arg = one_of(profile["select"], "select")
    keys, body = ["source_key", "doc_ord"], F.col("body")
    json = profile["parse"] == "json"
    if json:
        path = "$" if select == "document" else arg["path"]
        if not PATH.match(path):
            raise Invalid(f"select: path not supported: {path}")
        rows = computed(docs.select(*keys, "body"), [F.try_parse_json("body").alias("doc")])
        many = select == "json_path" and arg.get("unnest", True)
        found = F.try_variant_get("doc", path, "array<variant>") if many else F.array(F.try_variant_get("doc", path, "variant"))
        found = F.when(F.col("doc").isNotNull(), F.coalesce(found, F.array().cast("array<variant>")))
    else:
        rows = docs.select(*keys, "body")
        found = {
            "document": lambda: F.when(html.xml_valid(body) if profile["parse"] == "xml" else body.isNotNull(), F.array(body)), "css": lambda: html.css_text(body, arg),
            "xml_element": lambda: html.xml_element(body, arg), "xml_text": lambda: html.xml_text(body, arg), "sitemap_urls": lambda: html.sitemap_urls(body, (arg or {}).get("pattern")),
        }[select]()
    rows = computed(rows, [found.alias("found")])
    empty = F.lit(None).cast("string") if select == "sitemap_urls" else F.lit("selection_empty")
    rows = rows.select(*keys, F.col("found").isNotNull().alias("parsed"), F.posexplode_outer("found").alias("item_ord", "item"))
    return rows.select(*keys, "item_ord", "item", F.when(~F.col("parsed"), "parse_failed").when(F.col("item").isNull(), empty).alias("code")), json


def items(profile: dict, docs: DataFrame) -> tuple[DataFrame, bool]:
    """(source_key, doc_ord, item_ord, item) and whether items are JSON."""
    rows, json = tagged(profile, docs)
    return rows.where(F.col("item_ord").isNotNull()).drop("code"), json


def several(profile: dict, scope: Scope) -> dict[str, Column]:
    """Of the scalar fields that take one value at most, those that may get several: their values."""
    single = {f: e for f, e in profile["extract"].items() if isinstance(e, dict) and e.get("cardinality", "one") in ("one", "optional")}
    # only these expressions can give more than one value
    many = {f: e for f, e in single.items() if set(e) & {"item_field", "json_path", "css_text", "css_attribute", "xml_text", "xml_element", "source_config"}}
    return {f: scalars(e, scope, f"extract.{f}") for f, e in many.items()}


def selected(profile: dict, scope: Scope, rows: DataFrame, keep: Column | None = None) -> DataFrame:
    """Items with their captures, without those that a capture or a condition drops, but for rows to `keep`. Fills the
    scope's captures and paths."""
    or_kept = (lambda c: keep | c) if keep is not None else (lambda c: c)
    if scope.json:
        ahead = {p: f"path_{i}" for i, p in enumerate(p for p in reads([profile.get("captures", []), profile.get("where", []), profile["extract"]]) if PATH.match(p))}
        rows = computed(rows, [c.alias(f"{kind}_{name}") for p, name in ahead.items() for kind, c in zip(("many", "single"), gets(F.col("item"), p), strict=True)])
        rows = computed(rows, [variant_texts(F.col("item"), p, (F.col(f"many_{name}"), F.col(f"single_{name}"))).alias(name) for p, name in ahead.items()])
        scope.paths.update({p: F.col(name) for p, name in ahead.items()})
    elif wanted := selectors([profile.get("captures", []), profile.get("where", []), profile["extract"]]):
        rows = computed(rows, [html.css_all(F.col("item"), wanted).alias("css")])  # one parse of an item for all selectors
        scope.css.update({w: F.col(f"css.c{i}") for i, w in enumerate(wanted)})
    for i, c in enumerate(profile.get("captures", [])):
        only(c, {"key", "from", "pattern"}, f"captures.{i}")
        name = f"capture_{c['key']}"
        rows = computed(rows, [value(c["from"], scope, f"captures.{i}").alias(f"from_{i}")])
        rows = computed(rows, [text.capture(F.col(f"from_{i}"), c["pattern"], c["key"]).alias(name)])
        rows = rows.where(or_kept(F.col(name).isNotNull()))  # a failed capture drops the item
        scope.captures[c["key"]] = F.col(name)
    for i, p in enumerate(profile.get("where", [])):
        rows = rows.where(or_kept(condition(p, scope, f"where.{i}")))
    return rows


def filled(profile: dict, scope: Scope, rows: DataFrame, wanted: list[str]) -> tuple[DataFrame, dict[str, Column], Column]:
    """Rows with the wanted fields' values; each field's value, null if it gets several and takes one; the names of those
    that do, in order."""
    whole = lambda e: isinstance(e, list) or e.get("cardinality") == "all"
    many = {f: c for f, c in several(profile, scope).items() if f in wanted}
    get = lambda f, e: many[f] if f in many else (lists if whole(e) else value)(e, scope, f"extract.{f}")
    rows = computed(rows, [get(f, profile["extract"][f]).alias(f"field_{f}") for f in wanted])
    at = {f: F.col(f"field_{f}") for f in wanted}
    got = {f: F.when(~text.too_many(c), text.first(c)) if f in many else c for f, c in at.items()}
    too_many = F.filter(F.array(*[F.when(text.too_many(at[f]), F.lit(f)) for f in many]).cast("array<string>"), lambda f: f.isNotNull())
    return rows, got, too_many


def extracted(profile: dict, scope: Scope, rows: DataFrame, wanted: list[str], whole: bool = False) -> DataFrame:
    """(source_key, doc_ord, item_ord, wanted fields): a scalar field that gets several values is null or, if the item is
    taken `whole` or not at all, drops it."""
    rows, got, too_many = filled(profile, scope, rows, wanted)
    rows = rows.where(F.size(too_many) == 0) if whole else rows
    return rows.select("source_key", "doc_ord", "item_ord", *[c.alias(f) for f, c in got.items()])


#: Most bytes of a diagnostic's message.
MESSAGE_BYTES = 512
MESSAGES = {"parse_failed": "the document does not parse", "selection_empty": "the selection has no items", "too_many_values": "several values where one is taken: "}


def cut_bytes(c: Column, most: int = MESSAGE_BYTES) -> Column:
    """The longest beginning of a text that has `most` UTF-8 bytes at most and ends with a whole character."""
    head = F.substring(c.cast("binary"), 1, most).cast("string")
    return F.when(F.octet_length(c) <= most, c).otherwise(F.regexp_replace(F.make_valid_utf8(head), "\uFFFD$", ""))


def observed(profile: dict, docs: DataFrame, config: dict | None = None) -> tuple[DataFrame, list[str], dict[str, int]]:
    """Items and diagnostics of one pass over the documents: (source_key, doc_ord, item_ord, the fields, `told`: code,
    field and message of what is wrong with the row), the fields, and how many diagnostics there are of each code.

    Rows without an item only carry a diagnostic of their document. An item
    whose field gets several values stays, with null there. The counts are
    metrics that the pass itself observes.
    """
    check(profile)
    rows, json = tagged(profile, docs)
    scope, lost = Scope(json, config or {}, {}), F.col("code").isNotNull()
    rows = selected(profile, scope, rows.where(lost | F.col("item_ord").isNotNull()), lost)
    fields = list(profile["extract"])
    rows, got, too_many = filled(profile, scope, rows, fields)
    note = lambda code, field, message: F.struct(code.alias("code"), field.cast("string").alias("field"), cut_bytes(message).alias("message"))
    document = F.array(note(F.col("code"), F.lit(None), F.element_at(F.create_map(*[F.lit(x) for k in MESSAGES.items() for x in k]), F.col("code"))))
    item = F.transform(too_many, lambda f: note(F.lit("too_many_values"), f, F.concat(F.lit(MESSAGES["too_many_values"]), f)))
    out = rows.select("source_key", "doc_ord", F.when(~lost, F.col("item_ord")).alias("item_ord"), *[F.when(~lost, c).alias(f) for f, c in got.items()], F.when(lost, document).otherwise(item).alias("told"))
    seen = Observation()
    count = lambda code: F.coalesce(F.sum(F.size(F.filter("told", lambda x: x["code"] == code))), F.lit(0)).cast("long").alias(code)
    once = written(out.observe(seen, *[count(code) for code in MESSAGES]))
    return once, fields, dict(seen.get)


def diagnostics(rows: DataFrame) -> DataFrame:
    """(source_key, doc_ord, item_ord, code, field, message) of the rows of `observed`."""
    return rows.select("source_key", "doc_ord", "item_ord", F.inline("told"))


def diagnose(profile: dict, docs: DataFrame, config: dict | None = None) -> DataFrame:
    """(source_key, doc_ord, item_ord, code, field): documents that don't parse, empty selections (but of a sitemap),
    and fields of items that get several values where they take one."""
    return diagnostics(observed(profile, docs, config)[0]).drop("message")


def accepted(profile: dict, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences, acceptance by source) of extracted items: one row an identity."""
    fields = list(profile["extract"])
    identity = profile.get("identity", fields[0])
    if identity not in fields:
        raise Invalid(f"identity: unknown field {identity}")
    found = found.where(F.coalesce(F.col(identity).cast("string"), F.lit("")) != "")
    reduced = grouped.reduce_fields(found, ["source_key", identity], [f for f in fields if f != identity], ["doc_ord", "item_ord"])
    accept = profile.get("accept", {})
    only(accept, {"requiredFields", "minResults", "minDescriptionLength"}, "accept")
    body = F.col("description") if "description" in fields else None
    gate = grouped.acceptance(reduced, "source_key", [F.col(f).cast("string") for f in accept.get("requiredFields", [])], accept.get("minResults", 0), body, accept.get("minDescriptionLength", 0))
    return reduced, gate


def run(profile: dict, docs: DataFrame, config: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(occurrences, acceptance by source) of stored documents (source_key, doc_ord, body).

    A scalar field that gets several values is null, and an identity that does
    drops its item; `diagnose` tells of both.
    """
    check(profile)
    rows, json = items(profile, docs)
    scope = Scope(json, config or {}, {})
    rows = selected(profile, scope, rows)
    return accepted(profile, extracted(profile, scope, rows, list(profile["extract"])))


def run_once(profile: dict, docs: DataFrame, config: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int]]:
    """What `run` and `diagnose` give, of one pass over the documents, and the diagnostics counted by code."""
    rows, fields, counts = observed(profile, docs, config)
    found = rows.where(F.col("item_ord").isNotNull()).select("source_key", "doc_ord", "item_ord", *fields)
    return *accepted(profile, found), diagnostics(rows), counts


def matching(profile: dict, scope: Scope, rows: DataFrame) -> DataFrame:
    """Items for which every predicate of the profile's `match` holds; they know their posting."""
    for i, p in enumerate(profile.get("match", [])):
        rows = rows.where(condition(p, scope, f"match.{i}"))
    return rows


def detail(profile: dict, postings: DataFrame, docs: DataFrame, wanted: list[str], config: dict | None = None) -> DataFrame:
    """Postings (posting_id, meta) with what their detail documents (posting_id, doc_ord, body) say of the `wanted` fields.

    A document's selection has to hold exactly one item for its posting: if the profile has a `match`, exactly one for
    which that holds. Captures and expressions may read the posting's meta. `status` is missing, unmatched (items, but none
    matches), multiple, failed (an item dropped), rejected (the profile's `accept`: a required field is empty, or the
    description too short) or found. Fields that several documents of a posting tell differently are null and listed.
    Fields that aren't wanted are never extracted.
    """
    check(profile)
    if extra := set(wanted) - set(profile["extract"]):
        raise Invalid(f"detail: unknown fields {sorted(extra)}")
    accept = profile.get("accept", {})
    only(accept, {"requiredFields", "minDescriptionLength"}, "accept")
    rows, json = items(profile, docs.withColumnRenamed("posting_id", "source_key"))
    known = postings.select(F.col("posting_id").alias("source_key"), "meta")
    rows = rows.where(F.col("item").isNotNull()).join(known, "source_key")
    scope = Scope(json, config or {}, {}, meta=F.col("meta"))
    mine = matching(profile, scope, rows)
    counted = mine.groupBy("source_key", "doc_ord").agg(F.count("*").alias("_n"))
    per = counted.groupBy("source_key").agg(F.max("_n").alias("_n"))
    some = rows.select("source_key").distinct().withColumn("_some", F.lit(True)) if profile.get("match") else per.select("source_key", F.lit(True).alias("_some"))
    one = mine.join(counted.where("_n = 1").select("source_key", "doc_ord"), ["source_key", "doc_ord"], "left_semi")
    one = selected(profile, scope, one)
    told = grouped.reduce_fields(extracted(profile, scope, one, wanted, whole=True), ["source_key"], wanted, ["doc_ord", "item_ord"])
    short = F.lit(False)
    for f in accept.get("requiredFields", []):
        if f in wanted:
            short = short | (F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "")
    if "description" in wanted:
        short = short | (F.coalesce(F.char_length("description"), F.lit(0)) < accept.get("minDescriptionLength", 0))
    status = F.when(F.col("_some").isNull(), "missing").when(F.col("_n").isNull(), "unmatched").when(F.col("_n") > 1, "multiple").when(F.col("n").isNull(), "failed").when(short, "rejected").otherwise("found")
    out = known.join(some, "source_key", "left").join(per, "source_key", "left").join(told, "source_key", "left")
    return out.select(F.col("source_key").alias("posting_id"), status.alias("status"), *[F.when(status == "found", F.col(f)).alias(f) for f in wanted], F.coalesce("conflicts", F.lit("")).alias("conflicts"))
