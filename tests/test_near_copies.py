"""Groups of near copies: few of their pairs are compared in full."""

import itertools
import random

from pyspark.sql import functions as F

from quarryline.operators import similar, topk
from quarryline.plans import catalogue

from .test_similar import parts, score


def test_few_pairs_are_scored(spark, monkeypatch):
    scored, seen = topk.scored, []

    def counted(pairs, feats, id_):
        seen.append(pairs.count())
        return scored(pairs, feats, id_)

    monkeypatch.setattr(topk, "scored", counted)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*words[: i % 50], f"x{i}", *words[i % 50 + 1 :], *["tail"] * (i % 3)])) for i in range(90)]
    feats = {i: parts(t) for i, t in docs}
    every = sorted((-score(feats[a], feats[b]), a, b) for a, b in itertools.combinations(feats, 2))[:5]
    got = topk.top_pairs(similar.features(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text"), "doc_id", 0.5, 5).orderBy(F.desc("score"), "a", "b").collect()
    assert [(round(r.score, 9)) for r in got] == [round(-s, 9) for s, _, _ in every]
    assert sum(seen) < 1000  # of 4,005 pairs


def test_common_phrases_make_few_pairs(spark, monkeypatch):
    """Texts of phrases that several have, though none has many: they meet on their rare shingles."""
    meeting, met = topk.meeting, []

    def counted(*args):
        pairs = meeting(*args)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(topk, "meeting", counted)
    monkeypatch.setattr(topk, "most", lambda a, b: F.lit(1.0))  # no pair is left out by its sizes
    texts = [" ".join(f"a{p} b{p} c{p} d{p}" for p in random.Random(i).sample(range(1500), 30)) for i in range(300)]
    df = spark.createDataFrame([*enumerate(texts), (300, texts[7] + " x")], "doc_id long, text string")
    got = topk.top_pairs(similar.features(df, "doc_id", "text"), "doc_id", 0.5, 1).collect()
    assert [(r.a, r.b) for r in got] == [(7, 300)] and sum(met) < 100


def test_equal_features_of_different_rows_are_all_found(spark):
    """Three rows of one score, the highest: the first pair by ids is wanted, whichever of them met first."""
    docs = [(3, "Some words of a text"), (1, "some  words of a text"), (2, "some words of a TEXT"), (4, "other words"), (5, "other words x y")]
    df = similar.features(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    assert [(r.a, r.b, r.score) for r in topk.top_pairs(df, "doc_id", 0.5, 1).collect()] == [(1, 2, 1.0)]


def test_only_the_rows_of_scored_pairs_get_their_features_again(spark, tmp_path, monkeypatch):
    features, rows = similar.features, []
    monkeypatch.setattr(similar, "features", lambda df, *args: rows.append(df.count()) or features(df, *args))
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join([*(f"{w}y{i // 2}" for w in words), *["tail"] * (i % 2)]) if i < 4 else f"a{i} b{i} c{i} d{i} e{i}", "s") for i in range(50)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["similar_pairs_report"](spark, str(tmp_path)).collect()
    assert {frozenset((r.left, r.right)) for r in got} == {frozenset((0, 1)), frozenset((2, 3))}
    assert rows[0] == 50 and len(rows) > 1 and max(rows[1:]) <= 4


ODD = ["", None, " \t\n ", "one", "one two", "¿Qué? «voilà» — naïve… ̈x ²x Ⓐ x² x‍ _a_ 1.5 a-b", "a b\x85c\xa0d e\x1ff", "\x0b first Line\r\nsecond? line for for If", "If if. (if) iF? else"]


def test_features_of_odd_texts(spark):
    got = {r.id: r for r in similar.features(spark.createDataFrame(list(enumerate(ODD)), "id long, text string"), "id", "text").collect()}
    # the same in plain built-in functions, from which the features were made before
    plain = F.coalesce("text", F.lit(""))
    toks = F.filter(F.split(F.lower(plain), r"\s+"), lambda x: x != "")
    first = F.filter(F.split(F.lower(F.regexp_extract(plain, r"^\s*([^\r\n]*)", 1)), r"\s+"), lambda x: x != "")
    words = F.filter(F.transform("toks", lambda x: F.regexp_replace(x, r"(?U)^\W+|\W+$", "")), lambda x: x != "")
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, text string").select("id", "text", toks.alias("toks"), first.alias("first")).withColumn("words", words)
    for r in df.select("id", "text", "words", similar.shingles(F.col("toks")).alias("body"), similar.shingles(F.col("first")).alias("signature")).collect():
        own = got[r.id]
        assert (len(own.body), len(own.signature)) == (len(r.body), len(r.signature)), r
        assert len(own.identifiers) == len(set(r.words) - set(similar.IGNORED)), r
        assert own.control == [*(r.words.count(c) for c in similar.CONTROL), (r.text or "").count("?")], r
        assert all(list(x) == sorted(set(x)) for x in (own.body, own.identifiers, own.signature))
