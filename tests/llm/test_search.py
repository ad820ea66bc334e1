"""Ranked search and divergence audit against plain second implementations, with odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarryline.llm import divergence, ranked_search

from .fixtures import SCHEMA

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rnd, n):
    return " ".join(rnd.choice(["The", "of", "É", "é", "Zürich", "日本", "x1", "42"]) if rnd.random() < 0.4 else f"w{int(rnd.paretovariate(0.7)) % 300}" for _ in range(n))


def table():
    rnd = random.Random(8)
    texts = [prose(rnd, rnd.randrange(60)) for _ in range(150)]
    texts += [texts[3]] * 40 + [None, "", " \x0b\x85-- ", "THE the The", "the " * 9_000 + "w1"]  # copies tie; a very long text
    rows = [(i * 7 % 1000, t, rnd.choice(["en", "fr", None, ""]), rnd.choice(["a", "b", "é", None]), None, 1, "k", 0.0) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[3], "en", "a", None, None, None, None), (2**63 - 1, texts[3], "xx", "only", None, None, None, None)]


ITEMS = [(0, "the W7 w1 of w1"), (1, "ZÜRICH zürich É 日本"), (2, None), (3, "nowhere to be found"), (4, "42 x1 w250 w3 w4 w5 w6 w8"), (4, "same number, other text: w2"), (None, "w9 the"), (0, "the W7 w1 of w1")]


def ranked(rows, items, top):
    docs = [(i, ALNUM.findall((t or "").translate(SMALL))) for i, t, *_ in rows]
    docs = [(i, Counter(w), len(w)) for i, w in docs if w]
    total, df = sum(n for _, _, n in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, n in docs:
            m = 100 - 25 + (25 * n * len(docs)) // total
            s = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in ALNUM.findall((text or "").translate(SMALL)) if t in c)
            if s:
                scores.append((-s, i is None, i))
        out += [(item, text, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("fanout", "cells", "block"), [(16, 6_000_000, 4_000_000), (2, 400, 4_000_000), (4, 6_000_000, 20)])
def test_ranked_search(spark, monkeypatch, fanout, cells, block):
    """One tree, deep small trees, several blocks of items."""
    monkeypatch.setattr(ranked_search, "FANOUT", fanout)
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    monkeypatch.setattr(ranked_search, "RUN", fanout**3)
    rows = table()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, score string")
    got = ranked_search.search(docs, items, 20, block).collect()
    assert sorted(map(tuple, got), key=str) == ranked(rows, ITEMS, 20)
    assert sum(r["rank"] == 20 for r in got) >= 3


def test_only_promising_nodes_are_opened(monkeypatch):
    """The best of 4096 documents in a few openings, and no open bound at the end that could still win."""
    draw = np.random.default_rng(1)
    scores = draw.integers(1, 1000, (3, 4096))
    scores[:, 777] += 5000
    terms, doc = np.repeat(np.arange(3), 4096), np.tile(np.arange(4096), 3)
    trees = ranked_search.Trees(list(range(4096)), doc, terms, scores.ravel())
    opened = []
    monkeypatch.setattr(ranked_search.np, "flatnonzero", lambda x, f=np.flatnonzero: opened.append(1) or f(x))
    best = []
    trees.search(Counter({0: 1, 2: 2}), best, 1)
    assert best == [(-int(scores[0, 777] + 2 * scores[2, 777]), 777)] and len(opened) == 3


def test_ties_go_to_the_smallest_ids():
    ids = list(range(0, 8192, 2))
    trees = ranked_search.Trees(ids, np.arange(4096), np.zeros(4096, np.int64), np.full(4096, 9))
    best = [(-9, 5), (-9, 7777)]
    trees.search(Counter({0: 1}), best, 4)
    assert best == [(-9, 0), (-9, 2), (-9, 4), (-9, 5)]


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(table()[:5], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(none, items).count() == 0 and ranked_search.search(some, items.limit(0)).count() == 0
    assert divergence.audit(none).count() == 0


def audited(rows, least, top):
    rows = [(lang or "", source or "", LETTERS.findall((t or "").translate(SMALL))) for _, t, lang, source, *_ in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(s, Counter(w)) for x, s, w in rows if x == lang]
        df = Counter(t for _, c in mine for t in c)
        kept = [t for t in df if df[t] >= least]
        groups = defaultdict(Counter)
        for s, c in mine:
            groups[s].update({t: c[t] for t in kept if t in c})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(-sum(abs(p[s][t] - p[x][t]) for t in kept), x.encode(), x) for x in groups if x != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            out += [(lang, s, part, x, -v, k + 1) for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])) for k, (v, _, x) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "held"), [(3, 50, 10**6), (5, 4, 20), (10**6, 5, 10**6)])
def test_divergence_audit(spark, monkeypatch, least, top, held):
    """With all terms, with counts handed on early and few ranks, and with no term kept at all."""
    monkeypatch.setattr(divergence, "HELD", held)
    rows = table()
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("score", "value").repartition(3)
    got = sorted(map(tuple, divergence.audit(docs, least, top).collect()))
    assert got == audited(rows, least, top)
    assert len(got) > 20
