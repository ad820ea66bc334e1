"""Similar documents against all pairs, compared in plain Python."""

import itertools
import re

import pytest

from quarryline.operators import similar, topk
from quarryline.plans import catalogue

PROSE = "the quick brown fox jumps over the lazy dog while rain falls on a quiet town near the old river bank and nobody asks why it never ends".split()


def runs(toks):
    return {" ".join(toks[i : i + 3]) for i in range(max(1, len(toks) - 2))} if toks else set()


def parts(text):
    toks = text.lower().split()
    lines = text.strip().splitlines()
    words = [w for w in (re.sub(r"^\W+|\W+$", "", t) for t in toks) if w]
    return runs(toks), {w for w in words if w not in similar.IGNORED}, runs(lines[0].lower().split() if lines else []), [words.count(c) for c in similar.CONTROL] + [text.count("?")]


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def score(a, b):
    if a == b:
        return 1.0
    most = sum(map(max, a[3], b[3]))
    return 0.55 * share(a[0], b[0]) + 0.2 * share(a[1], b[1]) + 0.15 * share(a[2], b[2]) + 0.1 * (sum(map(min, a[3], b[3])) / most if most else 1.0)


def documents(copies):
    base = " ".join(PROSE)
    docs = [(base, "en"), (base, "de"), (base, None), (base.replace("quick", "slow"), None), (base + " again", None), (" ".join(PROSE[9:] + PROSE[:9]), "fr"), ("a b c a b c a b", "en"), ("a b c a b c a b c", "es")]
    docs += [("Head line\n" + " ".join(PROSE[i:] + PROSE[: i // 2]) + "?" * (i % 3), "en") for i in range(0, 12, 2)] + [("", "en"), (None, None), ("other words are here", "en"), ("x", None)]
    docs += [(base.replace("dog", "cat"), "en")] * copies
    return [(i, t, lang) for i, (t, lang) in enumerate(docs[::-1])]


@pytest.mark.parametrize("copies", [1, 4, 130])
def test_registered_query_against_all_pairs(spark, tmp_path, copies):
    docs = documents(copies)
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["shingle_similarity_topk"](spark, str(tmp_path)).collect()
    feats = {i: parts(t or "") for i, t, _ in docs}
    every = [(score(feats[a], feats[b]), a, b) for a, b in itertools.combinations(feats, 2)]
    best = sorted((p for p in every if p[0] >= 0.5 - 1e-12), key=lambda p: (-round(p[0], 10), p[1], p[2]))[:100]
    assert sorted((r.a, r.b, r.percent) for r in got if r.kind == "pair") == sorted((a, b, pytest.approx(100 * s, abs=0.006)) for s, a, b in best)
    rep = {i: min(j for j in feats if feats[j] == feats[i]) for i in feats}
    assert sorted((r.a, r.b) for r in got if r.kind == "member") == sorted((r, i) for i, r in rep.items() if r != i)


def test_members_of_equal_titles(rows):
    df = rows("id int, g string, s array<string>", (3, "x", ["a"]), (1, "x", ["a"]), (2, None, ["a"]), (4, None, ["a"]), (5, "x", []))
    assert {r.id: r.rep for r in similar.members(df, "id", ["g", "s"]).collect()} == {1: 1, 3: 1, 2: 2, 4: 2, 5: 5}


@pytest.mark.parametrize(("k", "threshold"), [(1, 0.5), (7, 0.46), (40, 0.6), (1000, 0.46)])
def test_top_pairs_against_all_pairs(spark, k, threshold):
    """Without copies: one best pair, several, more than there are."""
    docs = list(enumerate({str(parts(t or "")): t or "" for _, t, _ in documents(1)}.values()))
    feats = {i: parts(t) for i, t in docs}
    every = sorted((-round(score(feats[a], feats[b]), 10), a, b) for a, b in itertools.combinations(feats, 2))
    want = [(a, b, pytest.approx(-s)) for s, a, b in every if -s >= threshold - 1e-12][:k]
    df = similar.features(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    got = topk.top_pairs(df, "doc_id", threshold, k).collect()
    assert [(r.a, r.b, r.score) for r in sorted(got, key=lambda r: (-round(r.score, 10), r.a, r.b))] == want and want


def test_rounds_end_when_nothing_better_is_left(spark, monkeypatch):
    """A pair that differs in the last word is found on the rare shingles; the common ones never take part."""
    joined = []
    meeting = topk.meeting
    monkeypatch.setattr(topk, "meeting", lambda rows, before, bound, floor: joined.append((before, bound)) or meeting(rows, before, bound, floor))
    docs = [(i, " ".join(f"w{i // 2}x{j}" for j in range(60)) + " and so on to the end of it" + " last" * (i % 2)) for i in range(80)]
    df = similar.features(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    got = topk.top_pairs(df, "doc_id", 0.5, 10).collect()
    assert [(r.a, r.b) for r in got] == [(2 * i, 2 * i + 1) for i in range(10)] and len(joined) <= 2


def test_report(spark):
    rows = spark.createDataFrame([(1, "b.rs", 3, ["x", "y"]), (2, "a.rs", 9, ["y", "z", "q"]), (3, "a.rs", 9, [])], "id long, file string, line int, words array<string>")
    pairs = spark.createDataFrame([(1, 2, 0.75, 0.5, 1.0, 0.333333, 1.0), (2, 3, 0.75, 0.0, 0.0, 0.0, 0.0)], "a long, b long, score double, body double, identifiers double, signature double, control double")
    got = topk.report(rows, "id", ["file", "line", "id"], pairs, ["words"]).collect()
    assert [(r.left, r.right, r.score_percent, r.signature_percent, r.words_only_left, r.words_only_right) for r in got] == [(2, 3, 75.0, 0.0, "q | y | z", ""), (2, 1, 75.0, 33.33, "q | z", "x")]
