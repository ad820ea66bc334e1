"""The learned operators against plain second implementations: an EM step and predictions, a round of exchange, calibration and final scores."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarryline.llm import language_id, quality
from quarryline.llm.lattice import Vocabulary, units_of

PIECES = [" ", "a", "b", "c", "ab", "bc", " a", " ab", "abc", "ca", None]


@pytest.fixture
def small():
    """Ten pieces and the 256 bytes."""
    pieces = [*PIECES, *[None] * 256]
    weight = np.array([1 / (i + 1) if p is not None else 0.0 for i, p in enumerate(PIECES)] + [0.01] * 256)
    with np.errstate(divide="ignore"):
        return Vocabulary(pieces, list(range(len(PIECES), len(PIECES) + 256)), np.log(weight / weight.sum()))


def ways(unit, vocab):
    """All segmentations of a unit, as lists of piece ids; characters outside the vocabulary are spelt in bytes."""
    if not unit:
        return [[]]
    at = {p: i for i, p in enumerate(vocab.pieces) if p is not None}
    out = [[at[unit[:n]], *rest] for n in range(1, len(unit) + 1) if unit[:n] in at for rest in ways(unit[n:], vocab)]
    if unit[0] not in at:
        out += [[*[vocab.byte_ids[x] for x in unit[0].encode()], *rest] for rest in ways(unit[1:], vocab)]
    return out


def mass(unit, p, vocab):
    return sum(math.prod(p[i] for i in w) for w in ways(unit, vocab))


TEXTS = [(3, "abc ab caé"), (4, "bca"), (6, "cab a\nabcabc"), (9, "aab bb"), (12, "ccc bc"), (14, "b"), (17, "ca\nca Zürich")]


def test_em_and_predictions(spark, small, monkeypatch):
    """Every round's probabilities by enumeration, then each text's probability of each language."""
    monkeypatch.setattr(language_id.Vocabulary, "load", classmethod(lambda cls, path=None: small))
    rows = [(i, t, "xy"[k % 2]) for k, (i, t) in enumerate(TEXTS)]
    p = {}
    for lang in "xy":
        q = np.exp(small.log_weight)
        for _ in range(language_id.ROUNDS):
            used = np.zeros(len(q))
            for _, t, k in rows:
                for unit in units_of(t.lower()) if k == lang else ():
                    total = mass(unit, q, small)
                    for w in ways(unit, small):
                        for piece in w:
                            used[piece] += math.prod(q[i] for i in w) / total
            used[np.isfinite(small.log_weight)] += language_id.SMOOTH
            q = used / used.sum()
        p[lang] = q
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, log_p = language_id.fit(docs, small)
    assert langs == ["x", "y"]
    for k, lang in enumerate(langs):
        np.testing.assert_allclose(np.exp(log_p[:, k]), p[lang], rtol=1e-9, atol=1e-15)
    df = spark.createDataFrame([(*r, False) for r in rows], "doc_id long, text string, lang string, held_out boolean").select("doc_id", "held_out", "text")
    got = {r.doc_id: r for r in df.mapInArrow(language_id.predictor(small, langs, log_p), "doc_id long, held_out boolean, lang_pred string, score double").collect()}
    for i, t, _ in rows:
        both = {k: math.prod(mass(u, p[k], small) for u in units_of(t.lower())) for k in "xy"}
        best = max("xy", key=both.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(both[best] / sum(both.values()), rel=1e-6)


def plain_fit(x, y, weight, steps=4000):
    """Ridge logistic regression by Newton steps on Python floats."""
    x = [[*r, 1.0] for r in x]
    m = len(x[0])
    ridge = [quality.RIDGE] * (m - 1) + [1e-3]
    beta = [0.0] * m
    for _ in range(12):
        p = [1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(r, beta, strict=True)))))) for r in x]
        grad = [sum(w * (t - q) * r[j] for r, t, w, q in zip(x, y, weight, p, strict=True)) - ridge[j] * beta[j] for j in range(m)]
        hess = [[sum(w * q * (1 - q) * r[i] * r[j] for r, w, q in zip(x, weight, p, strict=True)) + (ridge[i] if i == j else 0) for j in range(m)] for i in range(m)]
        step = np.linalg.solve(np.array(hess), np.array(grad)).tolist()
        beta = [b + s for b, s in zip(beta, step, strict=True)]
        if max(map(abs, step)) < 1e-4:
            break
    return beta


def dot(r, beta):
    return sum(a * b for a, b in zip([*r, 1.0], beta, strict=True))


def test_a_round_of_exchange_calibration_and_scores(spark, monkeypatch):
    """`train` on rows of features, with a pool, against the same steps in plain Python."""
    monkeypatch.setattr(quality, "ROUNDS", 1)
    monkeypatch.setattr(quality, "SOURCES", 4)
    monkeypatch.setattr(quality, "LANGS", 2)
    monkeypatch.setattr(quality, "SURE", 0.8)
    monkeypatch.setattr(quality, "PICKED", 10**6)  # all that are sure
    draw = np.random.default_rng(4)

    def row(good, k):
        words = sorted({int(w) for w in draw.integers(1, 12, 4)} | ({100} if good and draw.random() < 0.9 else {200}))
        return {"source": f"s{(2 if good and draw.random() < 0.8 else 0) + k % 2}", "lang": "en", "n_chars": int(50 + 40 * good + draw.integers(0, 30)), "shape": [float(good + draw.normal()), float(draw.normal())], "words": words}

    labelled = [{"good": int(k % 3 > 0), "aside": k % 5 == 0, **row(k % 3 > 0, k)} for k in range(90)]
    rest = [{**row(k % 2, k), "lot": k} for k in range(60)]
    table = pa.Table.from_pylist(labelled)
    schema = quality.FEATURES.replace(", shape", ", lot long, shape")
    pool = spark.createDataFrame([tuple(r[c] for c in ("source", "lang", "n_chars", "lot", "shape", "words")) for r in rest], schema).select("source", "lang", "n_chars", "shape", "words", "lot")
    model = quality.train(table, lambda telling: pool)

    fit = [r for r in labelled if not r["aside"]]
    held = Counter(w for r in fit for w in r["words"])
    n_good, errors = sum(r["good"] for r in fit), {}
    for w, n in held.items():
        a = sum(r["good"] for r in fit if w in r["words"])
        share = n / len(fit)
        errors[w] = abs(a / n_good - (n - a) / (len(fit) - n_good)) / math.sqrt(share * (1 - share) * (1 / n_good + 1 / (len(fit) - n_good))) if n >= 5 else 0
    telling = sorted(w for w in errors if errors[w] > 3)
    assert model.telling.tolist() == telling and {100, 200} <= set(telling)
    mean = [sum(r["shape"][j] for r in fit) / len(fit) for j in range(2)]
    scale = [math.sqrt(sum((r["shape"][j] - mean[j]) ** 2 for r in fit) / len(fit)) + 1e-6 for j in range(2)]

    def views(r):
        text = [*((v - m) / s for v, m, s in zip(r["shape"], mean, scale, strict=True)), *(float(w in r["words"]) for w in telling)]
        page = [0.0] * 7
        page[quality.columns_of([r["source"]], 4)[0]] = 1.0
        page[4 + quality.columns_of([r["lang"]], 2)[0]] = 1.0
        page[6] = math.log1p(r["n_chars"]) / 10
        return text, page

    def even(x, y):
        m = sum(y) / len(y)
        return plain_fit(x, y, [0.5 / m if t > 0.5 else 0.5 / (1 - m) for t in y])

    taught = [([views(r)[k] for r in fit], [float(r["good"]) for r in fit]) for k in range(2)]
    betas = [even(*t) for t in taught]
    moved = defaultdict(int)
    for r in rest:
        for k in range(2):  # what one view is sure of teaches the other
            p = 1 / (1 + math.exp(-dot(views(r)[k], betas[k])))
            if max(p, 1 - p) >= quality.SURE:
                taught[1 - k][0].append(views(r)[1 - k])
                taught[1 - k][1].append(float(p > 0.5))
                moved[k] += 1
    assert min(moved[0], moved[1]) > 5
    betas = [even(*t) for t in taught]
    np.testing.assert_allclose(model.text, betas[0], rtol=1e-3, atol=1e-3)
    np.testing.assert_allclose(model.page, betas[1], rtol=1e-3, atol=1e-3)
    away = [r for r in labelled if r["aside"]]
    y = [float(r["good"]) for r in away]
    margins = [[dot(views(r)[k], betas[k]) for r in away] for k in range(2)]
    line = [plain_fit([[m] for m in ms], y, [1.0] * len(y)) for ms in margins]
    both = [[line[k][0] * margins[k][i] + line[k][1] for k in range(2)] for i in range(len(away))]
    last = plain_fit(both, y, [1.0] * len(y))
    np.testing.assert_allclose(model.calibrated, line, rtol=1e-2, atol=1e-3)
    want = [1 / (1 + math.exp(-dot(b, last))) for b in both]
    x = [np.array([views(r)[k] for r in away]) for k in range(2)]
    np.testing.assert_allclose(model.scores(*x)[:, 0], want, rtol=1e-3, atol=1e-3)


def test_repeats_neither_shrink_nor_grow_the_sample(spark, monkeypatch):
    seen = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda rows, pool=None: seen.append(rows.num_rows) or train(rows, pool))
    docs = spark.createDataFrame([(i, f"words of text {i} " * (1 + i % 3), "s", "en", 9) for i in range(60)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    again = labels.unionByName(labels).unionByName(labels)
    for d, x in ((docs, labels), (docs, again), (docs.unionByName(docs.withColumn("text", quality.F.concat("text", quality.F.lit("!")))), labels)):
        quality.fit(d, x, exchange=False)
    assert seen[0] == seen[1] == seen[2] > 30
