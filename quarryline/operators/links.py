"""Links of Markdown files: where they lead, and what is wrong with those that lead nowhere.

A small helper reads each file's visible lines (no comments, fences, indented
blocks or code spans) into headings and link destinations. Addresses, slugs,
targets and anchors are columns; whether they exist is a join, so that a
repository of any size is checked without one process holding its files.
"""

from __future__ import annotations

import re
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import each

MARKS = pa.list_(pa.struct([("line", pa.int32()), ("kind", pa.string()), ("text", pa.string())]))
#: Why a link is wrong.
ENCODING, ESCAPES, MISSING, ANCHOR = "invalid URL encoding", "target escapes repository", "target does not exist", "heading anchor does not exist"


def blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def without_spans(text: str) -> str:
    """Code spans become spaces: a run of backticks up to the next run of its length."""
    runs, out, at, i = list(re.finditer("`+", text)), [], 0, 0
    while i < len(runs):
        j = next((j for j in range(i + 1, len(runs)) if len(runs[j][0]) == len(runs[i][0])), None)
        if j is not None:
            out += [text[at : runs[i].start()], blank(text[runs[i].start() : runs[j].end()])]
            at, i = runs[j].end(), j
        i += 1
    return "".join(out) + text[at:]


def visible(text: str) -> list[str]:
    fence, inside, after_blank, out = "", False, True, []
    for line in re.split(r"\r?\n", re.sub(r"<!--[\s\S]*?-->", lambda m: blank(m[0]), text)):
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence:
            if mark and mark[1].startswith(fence) and not line[mark.end() :].strip():
                fence = ""
            line = ""
        elif mark:
            fence, line = mark[1], ""
        elif not line.strip():
            after_blank, line = True, ""
        else:
            inside = bool(re.match(r" {4}|\t", line)) and (inside or after_blank)
            after_blank, line = False, "" if inside else line
        out.append(line)
    return without_spans("\n".join(out)).split("\n")


def inline(line: str) -> list[str]:
    """What stands in the round brackets behind `]`, with inner brackets in pairs."""
    out, at = [], 0
    while (at := line.find("](", at)) >= 0:
        depth, end = 1, None
        for m in re.compile(r"\\.|[()]").finditer(line, at + 2):
            depth += {"(": 1, ")": -1}.get(m[0], 0)
            if not depth:
                end = m.start()
                break
        if end is not None:
            out.append(line[at + 2 : end])
        at = at + 1 if end is None else end
    return out


def destination(raw: str) -> str:
    raw = raw.strip()
    if raw.startswith("<"):
        return raw[1 : raw.index(">")] if ">" in raw else raw
    return re.sub(r"\\([ ()])", r"\1", m[0]) if (m := re.match(r"(?:\\.|\S)+", raw)) else ""


def marks(text: str | None) -> list[dict]:
    """Headings and destinations of a file, with their lines from 1."""
    lines, out = visible(text or ""), []
    for i, (line, below) in enumerate(pairwise([*lines, ""]), 1):
        title = re.match(r"\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$", line)
        if title or (line.strip() and re.fullmatch(r"\s*(?:=+|-+)\s*", below)):
            out.append({"line": i, "kind": "heading", "text": title[1] if title else line.strip()})
        named = re.match(r"\s{0,3}\[[^\]]+\]:\s*(.+)$", line)
        found = [destination(d) for d in [*inline(line), *([named[1]] if named else [])]]
        out += [{"line": i, "kind": "link", "text": d} for d in found if d]
    return out


def slug(text: Column) -> Column:
    for pattern, by in ((r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]+>", ""), (r"[`*_~]", "")):
        text = F.regexp_replace(text, pattern, by)
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_\- ]", ""), r"\s+", "-")


def decoded(c: Column) -> Column:
    """Percent codes read as UTF-8; null if they aren't."""
    out = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    broken = F.contains(out, F.lit("�")) & ~F.contains(F.upper(c), F.lit("%EF%BF%BD")) & ~F.contains(c, F.lit("�"))
    return F.when(~broken, out)


def resolved(folder: Column, path: Column) -> Column:
    """A path from the repository's root, without dots; null if it leads out of it."""
    parts = F.filter(F.split(F.concat(folder, F.lit("/"), path), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))

    def step(acc, p):
        up = p == ".."
        at = F.when(up, F.slice(acc["at"], F.lit(1), F.greatest(F.size(acc["at"]) - 1, F.lit(0)))).otherwise(F.concat(acc["at"], F.array(p)))
        return F.struct(at.alias("at"), (acc["out"] | (up & (F.size(acc["at"]) == 0))).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: F.when(~acc["out"], F.array_join(acc["at"], "/")))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]*$", "")


def check_links(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, line, destination, reason) of the wrong links of Markdown `files` (path, text); `paths` has the path of every
    file of the repository. Null texts have no links; external destinations aren't judged."""
    found = files.select("path", F.inline(each(marks, MARKS, "text")))
    heads = found.where("kind = 'heading'").withColumn("base", slug(F.col("text")))
    nth = F.row_number().over(Window.partitionBy("path", "base").orderBy("line")) - 1
    anchors = heads.select(F.col("path").alias("page"), F.when(nth == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), nth.cast("string"))).alias("anchor")).distinct()
    own = paths.select("path").distinct()
    # every folder above a file is there, the root too
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    known = own.select(F.col("path").alias("target"), F.lit(False).alias("folder")).unionByName(own.select(F.explode(above).alias("target"), F.lit(True).alias("folder")).distinct())

    links = found.where("kind = 'link'").where(~F.col("text").rlike(r"^(?:/|(?i:[a-z][a-z0-9+.-]*):)"))
    file, fragment = F.regexp_extract("text", "^[^#]*", 0), F.regexp_extract("text", "(?s)#(.*)$", 1)
    links = links.select("path", "line", F.col("text").alias("destination"), decoded(F.regexp_extract(file, r"^[^?]*", 0)).alias("to"), decoded(fragment).alias("fragment"))
    links = links.withColumn("target", F.when(F.col("to") == "", F.col("path")).otherwise(resolved(folder_of(F.col("path")), F.col("to"))))
    met = links.join(known, "target", "left")
    page = F.when(F.col("folder"), F.concat_ws("/", F.when(F.col("target") != "", F.col("target")), F.lit("README.md"))).otherwise(F.col("target"))
    met = met.withColumn("page", F.when((F.col("fragment") != "") & F.lower(page).endswith(".md"), page))
    met = met.join(anchors.withColumn("there", F.lit(True)), (met["page"] == anchors["page"]) & (met["fragment"] == anchors["anchor"]), "left").drop(anchors["page"])
    reason = (
        F.when(F.col("to").isNull() | F.col("fragment").isNull(), ENCODING).when(F.col("target").isNull(), ESCAPES).when(F.col("folder").isNull(), MISSING)
        .when(F.col("page").isNotNull() & F.col("there").isNull(), ANCHOR)
    )
    return met.select(F.col("path"), "line", "destination", reason.alias("reason")).where("reason IS NOT NULL")
