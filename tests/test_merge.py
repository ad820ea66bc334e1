"""The merge in rounds against the fold, row by row."""

import random

import pandas as pd
import pytest

from quarryline.functions.keys import word_tokens
from quarryline.operators import link

WORDS = ["data", "engineer", "senior", "berlin", "lead", "m", "w", "d", "backend", "platform", "java", "cloud"]
CITIES = ["Berlin", "Berlin Mitte", "Berlin Mitte Nord", "Rome", "Rome Centro", "Oslo", "", "-", "Paris"]


def block(rnd, company, n, start):
    base = [rnd.sample(WORDS, rnd.randrange(2, 7)) for _ in range(4)]
    rows = []
    for i in range(n):
        title = list(rnd.choice(base))
        if rnd.random() < 0.4:
            title.append(rnd.choice(WORDS))
        if rnd.random() < 0.1:
            title = []
        places = [rnd.choice(CITIES) for _ in range(rnd.choice([0, 0, 1, 1, 1, 2, 3]))]
        rows.append((start + i * 12, company, " ".join(title), places))
    return rows


def folded(rows):
    """The fold over all rows of a company in order, repeats and all."""
    out = {}
    for company in {r[1] for r in rows}:
        mine = sorted(r for r in rows if r[1] == company)
        frame = pd.DataFrame({"ord": [r[0] for r in mine], "title_tokens": [word_tokens(r[2]) for r in mine], "place_tokens": [[word_tokens(p) for p in r[3]] for r in mine]})
        out |= dict(zip(*[link.greedy(frame)[c] for c in ("ord", "cluster")], strict=True))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_rounds_equal_the_fold(spark, seed):
    rnd = random.Random(seed)
    rows = [r for c in range(12) for r in block(rnd, f"c{c}", 30, c)]
    df = spark.createDataFrame(rows, "o long, c string, t string, l array<string>")
    want = folded(rows)
    got = {r.ord: r.cluster for r in link.greedy_merge(df, "c", "t", "l", "o", 0).collect()}
    assert got == want and 20 < len(set(want.values())) < len(want) - 60
    assert {r.ord: r.cluster for r in link.greedy_merge(df, "c", "t", "l", "o", 25).collect()} == want  # some by fold


def test_many_rows_of_one_title_need_few_rounds(spark, monkeypatch):
    """A title in 300 cities, three times each: every city is a cluster of its own."""
    rounds = []
    decide = link.merge_rounds.decide
    monkeypatch.setattr(link.merge_rounds, "decide", lambda *a: rounds.append(1) or decide(*a))
    rows = [(i, "c", "data engineer", [f"city{i % 300}", f"suburb{i}"]) for i in range(900)]
    df = spark.createDataFrame(rows, "o long, c string, t string, l array<string>")
    got = {r.ord: r.cluster for r in link.greedy_merge(df, "c", "t", "l", "o", 0).collect()}
    assert got == {i: i % 300 for i in range(900)} and len(rounds) <= 4


def test_first_alike_equals_the_product(spark):
    rnd = random.Random(7)
    new, old = ([r for c in range(8) for r in block(rnd, f"c{c}", 25, c)] for _ in range(2))
    schema = "o long, c string, t string, l array<string>"
    sides = [link.keyed(spark.createDataFrame(x, schema), "c", "t", "l", "o") for x in (new, old)]
    key = lambda r: (r[1], word_tokens(r[2]), [word_tokens(p) for p in r[3]])
    want = {}
    for i, (c, t, p) in ((r[0], key(r)) for r in new):
        hits = [r[0] for r in old if (k := key(r))[0] == c and link.title_ok(k[1], t) and link.places_ok(k[2], p)]
        want |= {i: min(hits)} if hits else {}
    got = {r.ord: r.known_ord for r in link.first_alike(*sides).collect()}
    assert got == want and 30 < len(want) < len(new) and any(i != k for i, k in want.items())


def test_titles_meet_on_shared_prefixes_only(spark):
    """Of 2,000 known titles of one company a new one meets only those with its rare words."""
    schema = "company_key string, rep long, s array<string>"
    known = spark.createDataFrame([("c", i, sorted({"of", "the", f"w{i}", f"x{i}", f"y{i}"})) for i in range(2000)], schema)
    new = spark.createDataFrame([("c", 5, ["of", "the", "w7", "x7", "y7"]), ("c", 6, ["of", "the", "w8", "x8", "z"]), ("d", 7, ["of", "the", "w7", "x7", "y7"])], schema)
    got = sorted(map(tuple, link.similar.across(new, known, ["company_key"], 0.55).collect()))
    assert got == [(5, 7), (6, 8)]
