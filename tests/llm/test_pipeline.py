import os

import pytest

import corpus_pipeline as pipeline
from quarryline.llm import decontamination, near_dedup, secrets
from quarryline.llm.shared import written

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = written(stage(spark, docs, DATA))
        after = [r.doc_id for r in docs.collect()]
        assert docs.columns == columns and set(after) <= before and len(after) == len(set(after)), name
        assert len(after) > 0.7 * len(before), name
        if "dedup" in name:
            assert near_dedup.classes(docs).where("node != class_id").count() == 0
    assert decontamination.leaks(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    assert secrets.scan(docs)[0].where("size(spans) > 0").count() == 0
    out = pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert all(r.round_trip for r in out) and {r.doc_id for r in out} == set(after)


def test_repeated_rows_and_nulls(rows):
    df = rows("doc_id long, text string, lang string, source string, n_chars long, node long", (1, "a b c d e f", "en", "s", 1, 0), (1, "a b c d e f", "en", "s", 1, 0), (None, "a b c d e f", None, None, None, None), (2, None, None, None, None, None), (3, "other words here", "en", "s", 1, 0))
    out = pipeline.one_of_each(df.sparkSession, df, "").collect()
    assert sorted(str(r.text) for r in out) == ["None", "a b c d e f", "other words here"]


TABLE = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "one two three four five six seven eight nine ten"


def tables_in(folder, spark, docs, labels=(), benchmark=()):
    spark.createDataFrame(list(docs), TABLE).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_null_and_repeated_ids_lose_nothing(spark, tmp_path):
    other = "seven words that nobody else has here"
    docs = [(42, "forty two stays", "en", "s", 1), (None, None, None, None, None), (7, "seven stays", "en", "s", 1), (None, "nobody's text", None, None, None),
            (8, LONG, "en", "s", 1), (9, LONG, "en", "s", 1), (9, other, "en", "s", 1), (2**63 - 1, "the largest", "en", "s", 1), (-(2**63) + 9, "low", "en", "s", 1)]
    folder = tables_in(tmp_path, spark, docs, benchmark=[(1, "items that no document has at all")])
    held = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        held = written(stage(spark, held, folder))
    want = [(i, t) for i, t, *_ in docs if t != LONG] + [(8, LONG)]
    # with the largest number taken, the second text of 9 is numbered below 8, and stands for their class
    assert sorted(((r.doc_id if r.text != LONG else 8, r.text) for r in held.collect()), key=str) == sorted(want, key=str)
    got = pipeline.run(spark, folder).collect()
    assert len({(r.doc_id, tuple(r.ids)) for r in got if not r.draw}) == len(want) and all(r.round_trip for r in got)


def test_numbers_of_documents_are_their_own(rows):
    df = rows("doc_id long, text string", (42, "a"), (None, None), (None, None), (None, "b"), (7, "a"), (7, "b"), (7, "b"))
    keyed, node = near_dedup.with_nodes(df.withColumnsRenamed({"text": "text"}))
    got = {}
    for r in keyed.collect():
        got.setdefault((r.doc_id, r.text), set()).add(r[node])
    assert all(len(v) == 1 for v in got.values()) and len(set().union(*got.values())) == 5
    assert got[42, "a"] == {42} and {7} in (got[7, "a"], got[7, "b"])
    classes = {(r.node): r.class_id for r in near_dedup.classes(df).collect()}
    assert classes[42] == classes[min(got[7, "a"])] and classes[min(got[None, "b"])] == classes[min(got[7, "b"])]
    assert classes[min(got[None, None])] == min(got[None, None])


def test_empty_tables_pass(spark, tmp_path):
    folder = tables_in(tmp_path, spark, [])
    none = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
    assert pipeline.run(spark, folder).count() == 0


def test_a_run_leaves_one_table(spark, tmp_path, monkeypatch):
    """Of what a run writes between its stages only the last stage's input is left."""
    from quarryline.sources import tables

    spark.createDataFrame([(i, f"a few words of text {i}") for i in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    stage = lambda s, docs, d: tables.written(docs.where("doc_id > 0")).where("doc_id > 1")
    monkeypatch.setattr(pipeline, "STAGES", [("a", stage), ("b", stage), ("c", lambda s, docs, d: docs)])
    folders = lambda: {n for n in os.listdir(tables.shared_folder(spark).removeprefix("file:")) if n.startswith("table-")}
    before = folders()
    assert pipeline.run(spark, str(tmp_path)).count() == 2
    assert len(folders() - before) == 1
