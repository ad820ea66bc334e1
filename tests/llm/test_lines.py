"""Line dedup against brute force: bitmaps, kept texts, hot lines, odd rows."""

import random
import string

import pytest

from quarryline.llm import line_dedup

from .fixtures import SCHEMA, corpus

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def lined() -> list[tuple]:
    rnd = random.Random(3)
    shared = ["\tA Shared line of words\r", "Zweite gemeinsame Zeile ÄÖ", "ZWEITE gemeinsame zeile ÄÖ  ", "zweite gemeinsame zeile äö", "short", "ten chars!", "  TEN chars!", ""]
    texts = ["\n".join(rnd.choice(shared) if rnd.random() < 0.5 else f"line {rnd.randrange(60)} of its own" for _ in range(rnd.randrange(12))) for _ in range(60)]
    texts += [None, "", "\n", "\n\n", "a shared line of words", "x\x00y \U0001f600 ten or more", "X\x00Y \U0001f600 ten or more"]
    texts += ["\n".join(["A shared line of words", "a unique line here"] * 400 + [f"{i} at the end of it" for i in range(70_000)])]  # a very long text
    rows = [(i * 2, t, "en", "s", 1, 2, "k", 0.1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (rows[5][0], "A SHARED line of words\nof a repeated id, twice"), (None, "a shared line of words\nonly without a number"), (None, "only without a number\nten chars!")]
    return [r if len(r) == 8 else (*r, None, None, None, None, None, None) for r in rows] + corpus()[:20]


def brute(rows):
    order = lambda i: float("inf") if i is None else i
    key = lambda x: x.strip(BLANK).translate(LOWER)
    first = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            first[key(x)] = min(first.get(key(x), float("inf")), order(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= 10 and first[key(x)] < order(i) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), tuple(p for p, g in enumerate(gone) if g)))
    return sorted(out, key=str)


def positions(keep: bytes) -> tuple:
    """What a reader of the bitmap does, without Spark."""
    width = keep[0] if keep else 1
    at = [int.from_bytes(keep[i : i + width], "big") for i in range(1, len(keep), width)]
    return tuple(p for s, e in zip(at[::2], at[1::2], strict=True) for p in range(s, e))


@pytest.mark.parametrize("hot", [0, 1000])
def test_line_dedup(spark, monkeypatch, hot):
    """With no hash handled apart from the ranges, and with the most frequent ones."""
    monkeypatch.setattr(line_dedup, "hot_hashes", line_dedup.hot_hashes if hot else lambda lines: lines.select("h1").limit(0))
    rows = lined()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found, (n_lines, n_dropped, keep) = line_dedup.dedup(docs)
    texts = line_dedup.kept(found.withColumn("was", found["text"]), keep)
    got = [(r["doc_id"], r[n_lines], r[n_dropped], r["text"] or "", positions(r[keep])) for r in texts.collect()]
    assert sorted(got, key=str) == brute(rows)
    assert sum(g[2] for g in got) > 400


def test_hot_hashes_are_the_frequent_ones(spark):
    rows = [(i, f"the same line in all of them\nown line number {i}\nanother line in all of them") for i in range(300)]
    lines = line_dedup.line_hashes(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    often = {r["h1"] for r in lines.groupBy("h1").count().where("count > 200").collect()}
    assert {r["h1"] for r in line_dedup.hot_hashes(lines).collect()} == often and len(often) == 2


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a line to be kept", "x"), (2, "A line to be kept\nb", "y"), (3, None, None)], "doc_id long, text string, keep string")
    docs = docs.selectExpr("*", "keep AS n_lines", "keep AS edges", "keep AS doc", "keep AS a1", "keep AS _a1")
    found, (n_lines, n_dropped, keep) = line_dedup.dedup(docs)
    assert (n_lines, n_dropped, keep) == ("_n_lines", "n_dropped", "_keep") and found.columns[: len(docs.columns)] == docs.columns
    got = {r["doc_id"]: (r["text"], r["keep"], r["n_lines"], r[n_lines], r[n_dropped]) for r in line_dedup.kept(found, keep).collect()}
    assert got == {1: ("a line to be kept", "x", "x", 1, 0), 2: ("b", "y", "y", 2, 1), 3: (None, None, None, 1, 0)}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    found, _ = line_dedup.dedup(none)
    assert line_dedup.kept(found).count() == 0


def test_hashes_go_by_range_and_no_text_is_shuffled(spark):
    docs = spark.createDataFrame(lined(), SCHEMA)
    lines = line_dedup.written(line_dedup.line_hashes(docs))
    plan = line_dedup.repeats(lines)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "rangepartitioning(h1" in plan and "Python" not in plan and "text" not in plan.split("FileScan")[0]
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning(h1" not in plan
