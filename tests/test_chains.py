"""Chains longer and logs larger than recursive queries may get."""

from pyspark.sql import functions as F

from quarryline.operators import paging, sessions


def test_long_session(rows):
    n = 400
    df = rows("s string, id string, parent_id string, ord int", *[("a", str(i), str(i - 1) if i else None, i) for i in range(n)], ("b", "0", None, 0), ("b", "1", "0", 1))
    got = {(r.s, r.id): r.depth for r in sessions.active_path(df, "s").collect()}
    assert got == {("a", str(i)): n - 1 - i for i in range(n)} | {("b", "1"): 0, ("b", "0"): 1}


def test_damaged_session_ends(rows):
    df = rows("s string, id string, parent_id string, ord int", ("a", "1", "3", 0), ("a", "2", "1", 1), ("a", "3", "2", 2), ("b", "2", "gone", 0))
    assert sorted((r.s, r.id, r.depth) for r in sessions.active_path(df, "s").collect()) == [("a", "1", 2), ("a", "2", 1), ("a", "3", 0), ("b", "2", 0)]


def test_long_cursor_chain(rows):
    n = 300
    pages = [("a", str(i) if i else None, str(i + 1) if i + 1 < n else None) for i in range(n)] + [("b", None, "x"), ("b", "x", ""), ("b", "", "y"), ("b", "y", None)]
    df = rows("s string, cursor string, next_cursor string", *pages)
    got = sorted((r.s, r.step, r.cursor) for r in paging.cursor_chain(df, "s", 1000).collect())
    assert got == [("a", i + 1, str(i) if i else None) for i in range(n)] + [("b", 1, None), ("b", 2, "x")]
    assert paging.cursor_chain(df, "s", 150).where("s = 'a'").agg(F.max("step"), F.count("*")).first() == (150, 150)
