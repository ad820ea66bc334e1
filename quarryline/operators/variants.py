"""Which variant of a JSON schema a value is: schemas compiled to columns over VARIANT."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of a property that equals its const, and of one that is in its enum; a required key counts 1.
CONST, ENUM = 20, 5


def pointer(root: dict, path: str):
    """What a JSON pointer leads to, or None."""
    at = root
    for part in path.split("/")[1:] if path else []:
        part = part.replace("~1", "/").replace("~0", "~")
        at = at.get(part) if isinstance(at, dict) else at[int(part)] if isinstance(at, list) and part.isdigit() and int(part) < len(at) else None
    return at


def resolved(schema, root: dict, catalog: dict[str, dict] | None = None) -> tuple[dict, dict] | None:
    """A schema behind its $refs, and the document that its own $refs are read in; a $ref that comes again, or leads
    nowhere, ends the way."""
    seen: set[tuple[int, str]] = set()
    while isinstance(schema, dict) and isinstance(ref := schema.get("$ref"), str) and (id(root), ref) not in seen:
        seen.add((id(root), ref))
        document, _, path = ref.partition("#")
        home = (catalog or {}).get(document) if document else root
        target = pointer(home, path) if home is not None else None
        if not isinstance(target, dict):
            break
        schema, root = target, home
    return (schema, root) if isinstance(schema, dict) else None


def variants(schema: dict, catalog: dict[str, dict] | None = None) -> list[tuple[dict, dict]]:
    """The resolved members of a schema's oneOf, or else anyOf."""
    own = resolved(schema, schema, catalog)
    members = next((own[0][k] for k in ("oneOf", "anyOf") if isinstance(own[0].get(k), list)), []) if own else []
    return [x for m in members if (x := resolved(m, own[1], catalog))]


def at(value: Column, key: str) -> Column:
    if '"' in key or "\\" in key:
        raise ValueError(f"a key that no path can name: {key}")
    return F.try_variant_get(value, f'$["{key}"]', "variant")


def same(value: Column, wanted) -> Column:
    """Whether a value is this scalar; objects and arrays are equal to nothing."""
    text = F.to_json(value)
    if isinstance(wanted, (dict, list)):
        return F.lit(False)
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        return F.coalesce(text.rlike(r"^-?[0-9]") & (text.try_cast("double") == F.lit(float(wanted))), F.lit(False))
    if isinstance(wanted, str):
        return F.coalesce(text.startswith('"') & (F.try_variant_get(value, "$", "string") == F.lit(wanted)), F.lit(False))
    return F.coalesce(text == F.lit(json.dumps(wanted)), F.lit(False))


def score(schema: dict, root: dict, value: Column, catalog: dict[str, dict] | None = None) -> Column:
    """How well an object fits: 0 if a const differs, else points for consts, enums and required keys; 0 for no object."""
    total, clash = F.lit(0), F.lit(False)
    for key, own in (schema.get("properties") or {}).items() if isinstance(schema.get("properties"), dict) else ():
        got = at(value, key)
        found = resolved(own, root, catalog)
        rule = found[0] if found else {}
        if "const" in rule:
            clash = clash | (got.isNotNull() & ~same(got, rule["const"]))
            total = total + F.when(got.isNotNull(), CONST).otherwise(0)
        elif isinstance(rule.get("enum"), list):
            hit = F.lit(False)
            for x in rule["enum"]:
                hit = hit | same(got, x)
            total = total + F.when(got.isNotNull() & hit, ENUM).otherwise(0)
    for key in schema.get("required") if isinstance(schema.get("required"), list) else ():
        if isinstance(key, str):
            total = total + F.when(at(value, key).isNotNull(), 1).otherwise(0)
    object_ = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return F.when(object_ & ~clash, total).otherwise(0)


def best(schema: dict, value: Column, catalog: dict[str, dict] | None = None) -> Column:
    """The place of the variant with the highest score, of equal ones the first; null where none scores."""
    scores = [score(s, root, value, catalog) for s, root in variants(schema, catalog)]
    if not scores:
        return F.lit(None).cast("int")
    held = F.array(*scores)
    top = F.array_max(held)
    return F.when(top > 0, (F.array_position(held, top) - 1).cast("int"))
