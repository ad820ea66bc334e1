import itertools
import json

import pytest
from pyspark.sql import functions as F

from quarryline.operators import catalog, geo, link, live, paging, reduce, resolve, rules, sessions, similar
from quarryline.plans import profile


def test_no_includes_match_nothing(rows):
    df = rows("t string", ("Rust dev",))
    assert df.where(rules.title_matches(F.col("t"), [])).count() == 0
    assert df.where(rules.title_matches(F.col("t"), [("regex", "rust")])).count() == 0
    assert df.where(rules.title_matches(F.col("t"), [("text", "RUST")], [("regex", "DEV")])).count() == 0


def test_queues_are_a_partition(spark):
    states = list(itertools.product(["unread", "read", "opened"], ["undecided", "interested", "dismissed"], ["none", "started", "done"], ["open", "applied"]))
    df = spark.createDataFrame(states, "r string, i string, p string, a string")
    axes = [F.col(c) for c in "ripa"]
    q = rules.queue_predicates(*axes)
    five = ["archive", "applied", "inbox", "interested", "preparation"]
    got = df.select(*[q[k].cast("int").alias(k) for k in q], rules.primary_queue(*axes).alias("primary")).collect()
    for r in got:
        assert sum(r[k] for k in five) == 1 and r[r.primary] == 1
        assert r.new_inbox + r.review_inbox == r.inbox


def test_conflicts_never_heal(rows):
    df = rows("k int, o int, a string, b string", (1, 0, "x", None), (1, 1, "y", "z"), (1, 2, "x", "z"), (2, 0, "q", None))
    got = {r.k: r for r in reduce.reduce_fields(df, ["k"], ["a", "b"], ["o"]).collect()}
    assert (got[1].a, got[1].b, got[1].conflicts) == (None, "z", "a")
    assert (got[2].a, got[2].b, got[2].conflicts) == ("q", None, "")


def test_upsert_and_uniqueness(rows):
    old, new = rows("k int, v int", (1, 1), (2, 2)), rows("k int, v int", (2, 9), (3, 3))
    out = catalog.upsert(old, new, ["k"], {"v": F.col("s.v")}, {})
    assert sorted(map(tuple, out.collect())) == [(1, 1), (2, 9), (3, 3)]
    assert catalog.unique_or_raise(out, ["k"]).count() == 3
    with pytest.raises(Exception, match="not unique"):
        catalog.unique_or_raise(out.unionByName(old), ["k"]).collect()


def test_empty_changes_are_refused(rows):
    table, changes = rows("k int, a string, b string", (1, "x", "y")), rows("k int, a string, b string", (1, None, None))
    assert catalog.partial_update(table, changes, "k", ["a", "b"]).first() == (1, "x", "y")


def test_ids_follow_order(rows):
    df = rows("o int", *[(i,) for i in (5, 3, 9, 1)])
    assert {r.o: r.id for r in catalog.with_ids(df, "o", 10).collect()} == {1: 11, 3: 12, 5: 13, 9: 14}


def test_budget_states(rows):
    df = rows("k int, o int, c int", *[(1, i, 4) for i in range(5)])
    assert [r.state for r in reduce.within_budget(df, ["k"], ["o"], F.col("c"), 8).orderBy("o").collect()] == ["done", "done", "exhausted", "skipped", "skipped"]


def test_statuses(rows):
    df = rows("c int, f int, d int", (1, 0, 5), (0, 2, 0), (0, 0, 0), (0, 1, 1))
    assert [r.s for r in df.select(reduce.overall_status(*map(F.col, "cfd")).alias("s")).collect()] == ["cancelled", "failed", "completed", "completed_with_errors"]


def test_pages_stop(rows):
    df = rows("s string, n int, k int, total int", ("a", 0, 5, 12), ("a", 1, 5, 3), ("a", 2, 2, None), ("a", 3, 5, None), ("b", 0, 0, 9), ("b", 1, 4, 9))
    got = paging.pages_read(df, "s", "n", F.col("k"), F.col("total")).orderBy("s", "n").collect()
    assert [(r.s, r.n, r.read) for r in got] == [("a", 0, 5), ("a", 1, 10), ("a", 2, 12), ("b", 0, 0)]


def test_cursor_chain_ends_at_a_repeat(rows):
    df = rows("s string, cursor string, next_cursor string", ("a", None, "1"), ("a", "1", "2"), ("a", "2", "1"))
    assert [r.step for r in paging.cursor_chain(df, "s", 50).orderBy("step").collect()] == [1, 2, 3]


def test_sitemap_cycle(rows):
    edges = rows("parent string, child string", ("r", "a"), ("a", "r"), ("a", "b"), ("r", "b"))
    got = {r.node: r.depth for r in paging.sitemap_walk(edges, rows("n string", ("r",)), 5).collect()}
    assert got == {"r": 0, "a": 1, "b": 1}


def test_first_key_wins(rows):
    q = rows("q int, keys array<string>", (1, ["x", "y"]), (2, ["y"]), (3, ["z"]))
    got = geo.resolve_first_key(q, "q", "keys", rows("key string, place string", ("x", "X"), ("y", "Y"), ("y", "Y2")))
    assert sorted((r.q, r.place) for r in got.collect()) == [(1, "X"), (2, "Y"), (2, "Y2")]


def test_greedy_merge_depends_on_order(rows):
    df = rows(
        "o long, c string, t string, l array<string>", (0, "Acme", "Senior Data Engineer", ["Berlin"]), (1, "ACME", "senior data engineer (m/w/d)", ["Berlin Mitte"]),
        (2, "Acme", "Senior Data Engineer", ["Paris"]), (3, "Other", "Senior Data Engineer", ["Berlin"]), (4, "acme", "Senior Data Engineer", []), (5, "Acme", "Chef", ["Berlin"]),
    )
    assert {r.ord: r.cluster for r in link.greedy_merge(df, "c", "t", "l", "o").collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0, 5: 5}


def test_identity_conflict_is_shown(rows):
    known = rows("v string, posting_id long", ("a", 1), ("b", 2))
    got = link.exact_identity(rows("o int, v string", (0, "a"), (1, "a"), (1, "b"), (2, "z")), known, ["v"], "o")
    assert {r.o: r.status for r in got.collect()} == {0: "found", 1: "conflict", 2: "new"}


def test_token_measures(rows):
    df = rows("a array<string>, b array<string>", ([], []), ([], ["x"]), (["x", "y"], ["x", "y", "z"]))
    got = df.select(link.containment(F.col("a"), F.col("b")).alias("c"), link.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0), (0.0, 0.0), (1.0, 2 / 3)]


def test_resolution_accounts_for_all(rows):
    c = rows("o int, title string, company string, url string, n_places int", (0, "x", "c", "http://a/", 0), (1, "bad", "c", "http://a/", 0), (2, None, "c", "http://a/", 0), (3, None, "c", "http://a/", 0), (4, "x", "c", "http://a/", 0), (5, None, "c", "no", 0))
    d = rows("o int, d_title string, d_company string, d_places int, d_failed boolean", (2, "x", None, 0, False))
    got = resolve.resolve(c, "o", lambda t: t == "x", F.lit(True), False, d, 1)
    assert {r.o: r.status for r in got.collect()} == {0: "finalized", 1: "rejected", 2: "finalized", 3: "unresolved", 4: "budget_skipped", 5: "budget_skipped"}
    a = resolve.accounting(got).first()
    assert a.discovered == a.processed + a.budget_skipped == 6


def test_shingles_of_short_lists(rows):
    df = rows("t array<string>", (["a", "b", "c", "d"],), (["a"],), ([],))
    assert [r.s for r in df.select(similar.shingles(F.col("t")).alias("s")).collect()] == [["a b c", "b c d"], ["a"], []]


def test_similar_sets_against_all_pairs(spark):
    import random

    rnd = random.Random(4)
    sets = [(i, 0, rnd.sample(range(12), rnd.randint(1, 9))) for i in range(60)]
    df = spark.createDataFrame(sets, "id int, g int, s array<int>")
    got = {(r.a, r.b) for r in similar.similar_pairs(df, "id", ["g"], "s", 0.6).collect()}
    reps = {}
    for i, _, s in sets:
        reps.setdefault(frozenset(s), i)
    want = {tuple(sorted((i, j))) for (a, i), (b, j) in itertools.combinations(reps.items(), 2) if len(a & b) / len(a | b) >= 0.6}
    assert got == want


def test_session_log(rows):
    df = rows("s string, id string, parent_id string, ord int", ("a", "1", None, 0), ("a", "2", "1", 1), ("a", "3", "1", 2), ("b", "1", "2", 0), ("b", "2", None, 1))
    assert [r.id for r in sessions.active_path(df, "s").where("s = 'a'").orderBy("depth").collect()] == ["3", "1"]
    assert {r.s: r.whole for r in sessions.graph_faults(df, "s").collect()} == {"a": True, "b": False}
    body = F.lit(": hi\ndata: a\ndata:b\n\nevent: x\n\ndata: [DONE]\n\n")
    assert df.select(sessions.sse_events(body).alias("x")).first().x == ["a\nb", "[DONE]"]


def test_freshness_and_differences(rows):
    e, a = rows("k int, v int", (1, 1), (2, 2), (3, None)), rows("k int, v int", (2, 3), (3, None), (4, 4))
    assert {r.k: r.state for r in live.freshness(e, a, "k", "v").collect()} == {1: "missing", 2: "changed", 3: "same", 4: "unexpected"}
    assert sorted((r.k, r.side) for r in live.schema_difference(e.select("k"), a.select("k")).collect()) == [(1, "left"), (4, "right")]


BOARD = {
    "schemaVersion": 3, "key": "board", "parse": "json", "select": {"json_path": {"path": "$.jobs"}},
    "captures": [{"key": "id", "from": {"item_field": "url"}, "pattern": r"/(?<id>\d+)$"}],
    "where": [{"non_empty": {"item_field": "title"}}],
    "extract": {"url": {"item_field": "url"}, "title": {"item_field": "title", "transforms": ["trim"]}, "places": {"json_path": "$.places", "cardinality": "all"}, "ref": {"template": "b-{{capture:id}}"}},
    "accept": {"requiredFields": ["title"], "minResults": 2},
}


def test_profile_end_to_end(rows):
    jobs = [{"url": "http://x/1", "title": "  A b ", "places": ["P", " "]}, {"url": "http://x/2", "title": ""}, {"url": "http://x/none", "title": "C"}, {"url": "http://x/1", "title": "Other", "places": ["P"]}, {"url": "http://x/3", "title": 7}]
    docs = rows("source_key string, doc_ord int, body string", ("s", 0, json.dumps({"jobs": jobs})), ("s", 1, "{broken"))
    found, gate = profile.run(BOARD, docs)
    got = {r.url: r for r in found.collect()}
    assert set(got) == {"http://x/1", "http://x/3"}
    assert got["http://x/1"].title is None and got["http://x/1"].conflicts == "title" and got["http://x/1"].places == ["P"]
    assert got["http://x/3"].title == "7" and got["http://x/3"].ref == "b-3"
    assert gate.first().accepted is False  # a title was lost to a conflict


@pytest.mark.parametrize("change", [
    {"schemaVersion": 2}, {"extra": 1}, {"select": {"css": "a"}}, {"select": {"json_path": {"path": "$.a[0]"}}}, {"extract": {"t": {"capture": "none"}}}, {"extract": {"t": {"nonsense": 1}}}, {"identity": "none"},
])
def test_profiles_are_closed(rows, change):
    docs = rows("source_key string, doc_ord int, body string", ("s", 0, "{}"))
    with pytest.raises(profile.Invalid):
        profile.run(BOARD | change, docs)


def test_html_profile(rows):
    doc = {"schemaVersion": 3, "key": "h", "parse": "html", "select": {"css": "li.job"}, "extract": {"title": {"item_field": "value"}}}
    docs = rows("source_key string, doc_ord int, body string", ("s", 0, "<ul><li class=job>A</li><li>no</li><li class='job x'>B <i>c</i></li></ul>"))
    assert sorted(r.title for r in profile.run(doc, docs)[0].collect()) == ["A", "B c"]
