"""Sinks, source scans, list carriers, cardinality errors and details on small tables."""

import pytest
from pyspark.sql import functions as F

from quarryline.operators import reduce
from quarryline.plans import profile
from quarryline.sources import registry, sinks


def test_latest_reports_keep_other_sources(spark, rows, tmp_path):
    path = str(tmp_path / "reports")
    sinks.latest_reports(rows("source string, n int", ("a", 1), ("b", 1)), path, "source")
    sinks.latest_reports(rows("source string, n int", ("b", 2)), path, "source")
    assert {(r.source, r.n) for r in spark.read.json(path).collect()} == {("a", 1), ("b", 2)}


def test_artifacts_and_csv(spark, rows, tmp_path):
    df = rows("k int, v string", *[(i, f"v,{i}") for i in range(30)])
    sinks.run_artifact(df, str(tmp_path / "run"), [F.desc("k")], 4)
    assert sorted(r.k for r in spark.read.json(str(tmp_path / "run")).collect()) == [26, 27, 28, 29]
    sinks.csv_reports({"one": df, "two": df.limit(0)}, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "one")).count() == 30


def test_appends_refuse_a_changed_log(rows, tmp_path):
    path = str(tmp_path / "log")
    seen = sinks.append_lines(rows("k int", (1,)), path)
    then = sinks.append_lines(rows("k int", (2,)), path, seen)
    assert then[0] == 2
    with pytest.raises(sinks.Changed):
        sinks.append_lines(rows("k int", (3,)), path, seen)


def test_source_files(spark, tmp_path):
    for name, text in {"a.rs": b"fn a() {}\n", "sub/b.rs": b"\xff\xfe", "target/c.rs": b"x", "d.py": b"1\n2\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in registry.source_files(spark, str(tmp_path)).collect()}
    assert got == {"a.rs": ("fn a() {}\n", None), "b.rs": (None, "not UTF-8")}
    assert [r.lines for r in registry.listed_files(spark, str(tmp_path), ["d.py"]).collect()] == [2]


SHAPE = {"schemaVersion": 3, "key": "k", "parse": "json", "select": {"json_path": {"path": "$.items", "unnest": True}}, "extract": {"url": {"item_field": "u"}, "title": {"item_field": "t"}, "places": [{"item_field": "p"}, {"item_field": "q"}]}}


def test_several_values_are_null_and_told(rows):
    docs = rows("source_key string, doc_ord int, body string", ("s", 0, '{"items":[{"u":"1","t":["a","b"]},{"u":"2","t":"c","p":["x","y"],"q":"z"},{"u":["3","4"],"t":"d"}]}'), ("s", 1, "{"), ("s", 2, '{"items":[]}'), ("s", 3, None))
    found, _ = profile.run(SHAPE, docs)
    want = [("1", None, []), ("2", "c", ["x", "y", "z"])]
    assert sorted((r.url, r.title, r.places or []) for r in found.collect()) == want
    told = {(0, 0, "too_many_values", "title"), (0, 2, "too_many_values", "url"), (1, None, "parse_failed", None), (2, None, "selection_empty", None), (3, None, "parse_failed", None)}
    assert {(r.doc_ord, r.item_ord, r.code, r.field) for r in profile.diagnose(SHAPE, docs).collect()} == told
    found, _, notes, counts = profile.run_once(SHAPE, docs)
    assert sorted((r.url, r.title, r.places or []) for r in found.collect()) == want
    assert {(r.doc_ord, r.item_ord, r.code, r.field) for r in notes.collect()} == told
    assert counts == {"parse_failed": 2, "selection_empty": 1, "too_many_values": 2}


def test_documents_are_read_once(spark, tmp_path):
    spark.createDataFrame([("s", 0, '{"items":[{"u":"1"}]}')], "source_key string, doc_ord int, body string").write.parquet(f"{tmp_path}/docs")
    rows, json = profile.tagged(SHAPE, spark.read.parquet(f"{tmp_path}/docs"))
    lost = profile.F.col("code").isNotNull()
    plan = profile.selected(SHAPE, profile.Scope(json, {}, {}), rows, lost)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_html_is_parsed_once_for_all_selectors(rows):
    docs = rows("source_key string, doc_ord int, body string", ("s", 0, "<h1>t</h1><a href='/1'>x</a><i>y</i>"))
    shape = {"schemaVersion": 3, "key": "h", "parse": "html", "select": {"document": {}}, "where": [{"non_empty": {"css_text": "h1"}}], "extract": {"url": {"css_attribute": {"selector": "a", "attribute": "href"}}, "title": {"first_non_empty": [{"css_text": "b"}, {"css_text": "i"}]}, "all": [{"css_text": "i"}, {"css_text": "h1"}]}}
    found, _ = profile.run(shape, docs)
    assert [(r.url, r.title, r.all) for r in found.collect()] == [("/1", "y", ["y", "t"])]
    assert profile.selectors(shape) == [("h1", None), ("a", "href"), ("b", None), ("i", None)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("found(") <= 1


def test_malformed_xml(rows):
    docs = rows("source_key string, doc_ord int, body string", ("s", 0, "<urlset><url>"), ("s", 1, "<urlset><url><loc> a\n b </loc></url><x:loc xmlns:x='y'>c</x:loc><loc/></urlset>"), ("s", 2, "<urlset/>"), ("s", 3, None), ("s", 4, ""))
    shape = {"schemaVersion": 3, "key": "m", "parse": "xml", "select": {"sitemap_urls": {}}, "extract": {"url": {"item_field": "value"}}}
    found, _, told, counts = profile.run_once(shape, docs)
    assert sorted(r.url for r in found.collect()) == ["a b", "c"]
    assert sorted((r.doc_ord, r.code) for r in told.collect()) == [(0, "parse_failed"), (3, "parse_failed"), (4, "parse_failed")] and counts["parse_failed"] == 3
    for select in ({"xml_text": "urlset/url/loc"}, {"xml_element": "loc"}, {"document": {}}):
        told = {(r.doc_ord, r.code) for r in profile.diagnose({**shape, "select": select}, docs).collect()}
        assert {t for t in told if t[1] == "parse_failed"} == {(0, "parse_failed"), (3, "parse_failed"), (4, "parse_failed")}
        assert ((2, "selection_empty") in told) == ("document" not in select)


def test_messages_are_cut_at_whole_characters(rows):
    df = rows("t string", ("é" * 300,), ("x" + "é" * 300,), ("日" * 171,), ("😀" * 128,), ("short",), (None,))
    want = ["é" * 256, "x" + "é" * 255, "日" * 170, "😀" * 128, "short", None]
    assert [r.x for r in df.select(profile.cut_bytes(profile.F.col("t")).alias("x")).collect()] == want


def test_details(rows):
    postings = rows("posting_id long, meta map<string,string>", (1, {"c": "Acme"}), (2, {}), (3, {}), (4, {"c": "B"}))
    docs = rows("posting_id long, doc_ord int, body string", (1, 0, '{"items":[{"t":"x"}]}'), (1, 1, '{"items":[{"t":"y"}]}'), (2, 0, '{"items":[{"t":"x"},{"t":"y"}]}'), (4, 0, '{"items":[{"t":"x"}]}'))
    shape = {**SHAPE, "extract": {"title": {"item_field": "t"}, "company": {"posting_meta": "c"}, "url": {"const": "u"}}}
    got = {r.posting_id: (r.status, r.title, r.company, r.conflicts) for r in profile.detail(shape, postings, docs, ["title", "company"]).collect()}
    assert got == {1: ("found", None, "Acme", "title"), 2: ("multiple", None, None, ""), 3: ("missing", None, None, ""), 4: ("found", "x", "B", "")}
    with pytest.raises(profile.Invalid):
        profile.detail(shape, postings, docs, ["nothing"])
    with pytest.raises(profile.Invalid):
        profile.run(shape, docs.withColumnRenamed("posting_id", "source_key"))


def test_stricter_rules():
    assert reduce.stricter({"minResults": 3, "requiredFields": ["a"]}, {"minResults": 1, "minDescriptionLength": 9, "requiredFields": ["b", "a"]}) == {"minResults": 3, "minDescriptionLength": 9, "requiredFields": ["b", "a"]}
