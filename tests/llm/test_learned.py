"""Operators that learn, sample or search: accuracy on held-out rows, statistics, round trips, recall."""

import os
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quarryline.llm import decontamination, language_id, quality, sampled_pieces
from quarryline.llm.lattice import Vocabulary, units_of

from .fixtures import SCHEMA, corpus

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary.load()


def mutated(rnd, w, edits):
    w = list(w)
    for _ in range(edits):
        kind, i = rnd.randrange(3), rnd.randrange(len(w))
        if kind == 0:
            w[i] = f"x{rnd.randrange(99)}"
        elif kind == 1:
            w.insert(i, f"x{rnd.randrange(99)}")
        elif len(w) > 1:
            del w[i]
    return w


def test_leaks_are_found_and_only_these():
    rnd = random.Random(2)
    item = lambda: [f"i{rnd.randrange(300)}" for _ in range(rnd.randint(8, 60))]
    items = {k: item() for k in range(80)}
    held, texts = [], []
    for k, w in items.items():
        for share in (0, 0.1, 0.2):
            around = [f"d{rnd.randrange(500)}" for _ in range(100)]
            at = rnd.randrange(100)
            held.append(k)
            texts.append(" ".join([*around[:at], *mutated(rnd, w, int(share * len(w) + 1e-9)), *around[at:]]).title() + ".")
    texts += [" ".join(f"d{rnd.randrange(500)}" for _ in range(200)) for _ in range(50)]
    run = decontamination.finder([(k, " ".join(w)) for k, w in items.items()])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    got = {(d, i) for b in run([batch]) for d, i in zip(b["doc_id"].to_pylist(), b["item_id"].to_pylist(), strict=True)}
    want = set(enumerate(held))
    assert len(got & want) >= 0.98 * len(want)
    assert not {d for d, _ in got if d >= len(held)}


def least_edits(item, text):
    """Least edit distance of an item to any run of a text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_leaks_against_all_windows(spark):
    """The whole result against edit tables of every item and text."""
    rnd = random.Random(6)
    items = [(100 + k, " ".join(f"i{rnd.randrange(60)}" for _ in range(rnd.choice([1, 4, 5, 9, 14, 25, 40])))) for k in range(30)]
    texts = []
    for k in range(60):
        w = [f"d{rnd.randrange(80)}" for _ in range(40)]
        for _ in range(rnd.randrange(3)):
            leak = items[rnd.randrange(30)][1].split()
            at = rnd.randrange(len(w))
            w[at:at] = mutated(rnd, leak, rnd.randrange(int(0.3 * len(leak)) + 2))
        texts.append((k, " ".join(w), "extra"))
    texts += [(60, None, ""), (61, "", ""), (None, items[3][1], ""), (0, texts[0][1], "")]
    want = Counter()
    for d, t, _ in texts:
        for i, x in items:
            if (far := least_edits(x.split(), (t or "").split())) <= int(0.2 * len(x.split()) + 1e-9) and t:
                want[d, i, far] += 1
    docs = spark.createDataFrame(texts, "doc_id long, text string, item_id string").repartition(3)
    got = Counter((r.doc_id, r.item_id, r.distance) for r in decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    pairs = lambda c: {k[:2] for k in c}
    assert pairs(got) <= pairs(want) and len(want) > 60
    assert (want & got).total() >= 0.98 * want.total()


def test_many_items_with_one_beginning_and_a_long_item():
    rnd = random.Random(8)
    items = [(k, "alpha beta " + " ".join(f"i{rnd.randrange(5000)}" for _ in range(3))) for k in range(2000)]
    long_item = [f"l{rnd.randrange(900)}" for _ in range(2_000)]
    items.append((5000, " ".join(long_item)))
    words = [x for _ in range(2000) for x in ("alpha", "beta", f"i{rnd.randrange(5000)}")]
    words[3000:3000] = items[7][1].split()
    run = decontamination.finder(items)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([" ".join(words), " ".join(mutated(rnd, long_item, 60))])], ["doc_id", "text"])
    began = time.monotonic()
    got = {(d, i) for b in run([batch]) for d, i in zip(b["doc_id"].to_pylist(), b["item_id"].to_pylist(), strict=True)}
    assert time.monotonic() - began < 120
    assert {(1, 7), (2, 5000)} <= got


def test_leaks_odd_cases(rows, docs):
    none = rows("item_id long, text string")
    assert decontamination.leaks(docs, none).count() == 0
    held = rows("item_id long, text string, doc_id int", (1, None, 0), (2, "", 0), (3, "nobody KNOWS my, number", 0), (4, "!!", 0))
    got = decontamination.leaks(docs, held, block_chars=12).collect()
    assert [(r.doc_id, r.item_id, r.distance) for r in got] == [(None, 3, 0)]


def test_distances_against_the_plain_table():
    rnd = random.Random(3)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    for _ in range(50):
        a = [rnd.randrange(1, 5) for _ in range(rnd.randint(1, 9))]
        b = [rnd.randrange(1, 5) for _ in range(12)]
        padded = np.zeros((1, 9), np.uint64)
        padded[0, : len(a)] = a
        far, _ = decontamination.distances(padded, np.array([len(a)]), np.array([b], np.uint64))
        assert far[0] == plain(a, b)


@pytest.fixture(scope="module")
def trie(vocab):
    return vocab.trie()


def ways(tables, unit):
    (number,) = tables.numbers([unit])

    def go(node):
        if tables.lo[node + 1] == tables.lo[node]:
            yield (), 0.0
        for e in range(tables.lo[node], tables.lo[node + 1]):
            for path, q in go(int(tables.end[e])):
                yield (e, *path), tables.log_q[e] + q

    return list(go(int(tables.root[number])))


def seeds_of(n):
    return np.array([xxhash.xxh3_64_intdigest(f"k{i}") for i in range(n)], np.uint64)


@pytest.mark.parametrize("text", ["the that", "of and in", "that"])
def test_draws_follow_sampling_without_replacement(vocab, trie, text):
    tables = sampled_pieces.Tables(vocab, trie)
    units, p = units_of(text), {(): 1.0}
    for u in units:
        p = {a + b: q * np.exp(y) for a, q in p.items() for b, y in ways(tables, u)}
    assert abs(sum(p.values()) - 1) < 1e-9 and any(len(w) > len(units) for w in p)
    n, seen, weighed = 12_000, [Counter(), Counter()], Counter()
    for draws in sampled_pieces.draw_chunk(tables, [units] * n, seeds_of(n), 2):
        ids = [tuple(d[0].tolist()) for d in draws]
        assert len(set(ids)) == 2
        for c, i, d in zip(seen, ids, draws, strict=True):
            c[i] += 1
            assert abs(d[1] - np.log(p[i])) < 1e-9
            weighed[i] += p[i] / np.exp(d[2])
    for way in sorted(p, key=p.get, reverse=True)[:8]:
        second = sum(p[o] * p[way] / (1 - p[o]) for o in p if o != way)
        for got, want in ((seen[0][way] / n, p[way]), (seen[1][way] / n, second)):
            assert abs(got - want) < 4.5 * np.sqrt(want * (1 - want) / n) + 1e-3, (way, got, want)
        assert abs(weighed[way] / n - p[way]) < 0.1 * np.sqrt(p[way])  # inclusion scores make sums over samples unbiased


def test_draws_of_two_units_are_independent_of_each_other(vocab, trie):
    tables, n = sampled_pieces.Tables(vocab, trie), 12_000
    unit = " that"
    p = {w: np.exp(q) for w, q in ways(tables, unit)}
    both = Counter()
    for draws in sampled_pieces.draw_chunk(tables, [[unit] * 2] * n, seeds_of(n), 1):
        ids = tuple(draws[0][0].tolist())
        both[next((ids[:c], ids[c:]) for c in range(len(ids)) if ids[:c] in p)] += 1
    for a in sorted(p, key=p.get)[-3:]:
        for b in sorted(p, key=p.get)[-3:]:
            want = p[a] * p[b]
            assert abs(both[a, b] / n - want) < 4.5 * np.sqrt(want / n), (a, b)


def test_no_random_word_is_used_twice(vocab, trie, monkeypatch):
    used, plain = [], sampled_pieces.uniform

    def recorded(words, step=0):
        used.extend((np.asarray(words) + np.uint64((step + 1) * sampled_pieces.GOLDEN & sampled_pieces.MASK)).tolist())
        return plain(words, step)

    monkeypatch.setattr(sampled_pieces, "uniform", recorded)
    texts = ["the that of and in", "x" * 5000, " ", "to be or not to be " * 30]
    got = sampled_pieces.draw_chunk(sampled_pieces.Tables(vocab, trie), [units_of(t) for t in texts], seeds_of(4), 4)
    assert [len(g) for g in got] == [4, 4, 2, 4] and all(len({tuple(x[0].tolist()) for x in g}) == len(g) for g in got)
    assert len(used) > 5000 and len(set(used)) == len(used)


def test_forgetting_units_changes_no_draw(vocab, trie, monkeypatch):
    rnd = random.Random(4)
    texts = [[" " + "".join(rnd.choice("etaoins") for _ in range(rnd.randint(1, 7))) for _ in range(60)] for _ in range(40)]

    def pieces(parts):
        tables, out = sampled_pieces.Tables(vocab, trie), []
        for part in parts:
            drawn = sampled_pieces.draw_chunk(tables, texts[part], seeds_of(40)[part], 3)
            out += [(tables.pieces_of(x[0], np.array([len(x[0])]))[0].tolist(), x[1], x[2]) for g in drawn for x in g]
        return out

    whole = pieces([slice(0, 40)])
    monkeypatch.setattr(sampled_pieces, "CACHE", 300)
    assert pieces([slice(i, i + 8) for i in range(0, 40, 8)]) == whole


def test_all_segmentations_when_there_are_few(vocab, trie):
    tables = sampled_pieces.Tables(vocab, trie)
    few = len(ways(tables, " "))
    got = sampled_pieces.draw_chunk(tables, [units_of(""), [" "]], np.array([1, 2], np.uint64), few + 3)
    assert [len(g) for g in got] == [1, few]
    assert all(x[2] == 0 for x in got[1])  # all are included for certain


def test_encodings_decode_exactly(docs, rows):
    drawn = sampled_pieces.decode(sampled_pieces.encode(docs, k=3, check=True)).collect()
    texts = {r[0]: r[1] or "" for r in corpus()}
    assert all(r.round_trip and r.decoded == texts[r.doc_id] for r in drawn)
    assert {r.draw for r in drawn} == {0, 1, 2}
    odd = rows("doc_id long, text string", (1, "▁ a\n\n  b日本\t\U0001f600é́\x00"), (2, " " * 2000), (3, "q" * 3000))
    assert all(r.round_trip for r in sampled_pieces.encode(odd, check=True).collect())
    again = {(r.doc_id, r.draw): r.ids for r in sampled_pieces.encode(docs.repartition(7), k=3).collect()}
    assert all(again[r.doc_id, r.draw] == r.ids for r in drawn)
    assert sampled_pieces.encode(docs.limit(0)).count() == 0


def test_lattice_mass_is_the_sum_over_segmentations(vocab):
    from quarryline.llm.lattice import Lattices

    trie, size = vocab.trie(), len(vocab.pieces)
    lat = Lattices([" that", "\n", "the"], trie, size, spelt := {})
    from quarryline.llm.lattice import spell

    log_p = spell(vocab.log_weight, spelt, vocab.byte_ids)
    mass = lat.suffix_mass(log_p)[lat.first[:-1]]
    ids = {p: i for i, p in enumerate(vocab.pieces) if p is not None}

    def total(text):
        return 1.0 if not text else sum(np.exp(vocab.log_weight[ids[text[:j]]]) * total(text[j:]) for j in range(1, len(text) + 1) if text[:j] in ids)

    assert abs(mass[0] - np.log(total(" that"))) < 1e-9 and abs(mass[2] - np.log(total("the"))) < 1e-9


@tables
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in language_id.identify(docs, sample=60).collect() if r.held_out]
    assert sum(want[r.doc_id] == r.lang_pred for r in got) >= 0.95 * len(got)


def test_language_odd_cases(rows):
    schema = "doc_id long, text string, lang string, source string"
    df = rows(schema, *[(i, t, k, "s") for i, (t, k) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)], (90, None, "en", None), (91, "12 !!", "fr", None), (92, "", None, None), (None, "the the", None, None), (93, "x" * 3000, None, None))
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert [got[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3 and got[90].score == 0
    assert got[None].lang_pred == "en" and 0 <= got[93].score <= 1
    assert {r.lang_pred for r in language_id.identify(df.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()} == {"und"}
    assert language_id.identify(df.limit(0)).count() == 0


def accuracy(docs, labels, model):
    """Share of labelled held-out documents whose score is on the right side."""
    want = {r.doc_id: int(r.quality and not r.toxic) for r in labels.collect()}
    out, (score, *_) = quality.score(docs, model)
    got = [(want[r.doc_id], r[score] >= quality.KEEP) for r in out.where(quality.held_out()).collect() if r.doc_id in want]
    assert len(got) > 50
    return sum(w == g for w, g in got) / len(got)


@tables
def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    assert accuracy(docs, labels, quality.fit(docs, labels)) >= 0.8


def test_exchange_teaches_the_views(rows):
    """Few labels and noisy words, but telling sources: what the page view knows reaches the text view by the pool."""
    rnd = random.Random(9)
    good, bad = [f"g{i}" for i in range(12)], [f"b{i}" for i in range(12)]
    docs, truth = [], {}
    for i in range(3000):
        truth[i] = int(rnd.random() < 0.5)
        w = [rnd.choice(good if (rnd.random() < 0.85) == truth[i] else bad) if rnd.random() < 0.2 else f"n{rnd.randrange(400)}" for _ in range(20)]
        docs.append((i, " ".join(w), "site" if truth[i] else "farm", "en", None))
    labels = [(i, truth[i], 0) for i in range(0, 3000, 8)]
    df = rows("doc_id long, text string, source string, lang string, n_chars long", *docs)
    told = rows("doc_id long, quality int, toxic int", *labels)

    def text_accuracy(model):
        out, (_, text, _) = quality.score(df, model)
        got = [(truth[r.doc_id], r[text] > 0.5) for r in out.where(quality.held_out()).collect()]
        return sum(w == g for w, g in got) / len(got)

    alone, together = (text_accuracy(quality.fit(df, told, exchange=x)) for x in (False, True))
    assert together > alone and together > 0.75, (alone, together)


def test_fit_against_plain_gradient_descent():
    rnd = np.random.default_rng(3)
    x, weight = rnd.normal(size=(200, 3)), rnd.random(200)
    y = (x @ [1.0, -2.0, 0.5] + rnd.normal(size=200) > 0.3).astype(float)
    beta, ridge = np.zeros(4), np.array([quality.RIDGE] * 3 + [1e-3])
    wide = np.column_stack([x, np.ones(200)])
    for _ in range(20_000):
        beta -= 0.02 * (wide.T @ (weight * (1 / (1 + np.exp(-wide @ beta)) - y)) + ridge * beta)
    assert np.abs(quality.logistic(x, y, weight) - beta).max() < 1e-3


def test_quality_odd_cases(rows, docs):
    labels = "doc_id long, quality int, toxic int"
    assert quality.fit(docs, rows(labels)) is None
    out, names = quality.score(docs, None)
    assert out.columns == [*docs.columns, *names] and names[0] == "_score"
    half = [(i * 3, int(i % 2), None) for i in range(40)] + [(None, 1, 0), (3, None, None), (3, 0, 1)]
    model = quality.fit(docs, rows(labels, *half))
    scored, names = quality.score(docs, model)
    assert scored.count() == docs.count() and all(0 <= r[names[0]] <= 1 for r in scored.collect())
    assert quality.score(docs.limit(0), model)[0].count() == 0
