"""Substring dedup of rows that have no id of their own, of the largest id, and of long texts."""

import time

from quarryline.llm import substring_dedup

PASSAGE = " ".join(f"shared{i}" for i in range(300))


def texts(n, seed=0):
    return [" ".join(f"v{seed}x{i}x{j}" for j in range(60)) + " " + PASSAGE + f" end{i}" for i in range(n)]


def test_the_largest_id_is_a_number_and_comes_before_none(spark):
    rows = [(2**63 - 1, PASSAGE + " a"), (None, PASSAGE + " b"), (None, PASSAGE + " c"), (5, "x")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 301, 300), (0, 301, 300), (5, 1, 0), (2**63 - 1, 301, 0)]


def test_rows_without_an_id_or_with_one_id_cost_no_more(spark):
    took = []
    t = texts(1500)
    for ids in (range(1500), [None] * 1500, [7] * 1500):
        df = spark.createDataFrame(list(zip(ids, t, strict=True)), "doc_id long, text string").repartition(8)
        start = time.time()
        got = substring_dedup.dedup(df).collect()
        took.append(time.time() - start)
        assert sum(r.n_removed for r in got) == (1499 * 300 if ids == range(1500) else 0)
    assert max(took[1:]) < 2 * took[0] + 3


def test_ids_that_texts_share_split(spark):
    keys, _ = substring_dedup.numbered(spark.createDataFrame([(7, t) for t in texts(50)] + [(None, t) for t in texts(50, 1)] + [(1, "a"), (2, None)], "doc_id long, text string"))
    subs = {k: {r["sub"] for r in keys.collect() if r["ord"] == k} for k in (7, 1, 2, 2**63 - 1)}
    assert len(subs[7]) > 45 and max(subs[7]) < substring_dedup.NONE <= min(subs[2**63 - 1]) and len(subs[2**63 - 1]) > 45 and subs[1] == subs[2] == {0}


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 9973}" for i in range(120_000))
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup(spark.createDataFrame([(1, PASSAGE), (2, long + " " + PASSAGE)], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 300}
