"""Operators with one right answer, against brute force on a small corpus with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from quarryline.llm import chat, fingerprints, near_dedup, secrets, sharding, substring_dedup
from quarryline.llm.shared import components

from .fixtures import SCHEMA, corpus

KEYWORD = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_substring_dedup(docs, none):
    rows = corpus()
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, t, *_ in rows:
        w = split(t)
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            first[k] = min(first.get(k, float("inf")), order(i))
    want = []
    for i, t, *_ in rows:
        w, gone = split(t), set()
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < order(i):
                gone |= set(range(p, p + 50))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = [tuple(r) for r in substring_dedup.dedup(docs, with_text=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[2] for r in got) > 300
    assert substring_dedup.dedup(none).count() == 0


def test_cover_meets_every_alignment():
    c, v = substring_dedup.COVER, substring_dedup.PERIOD
    assert all(any((i + d) % v in c and (j + d) % v in c for d in range(v)) for i in range(v) for j in range(v))


def bag(text):
    w = split(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] * bool(w))


@pytest.mark.parametrize("members", [400, 7])
def test_whole_buckets_are_compared(spark, monkeypatch, members):
    """One bucket of versions around 0.8, in one block and in many: the classes that any two members' link joins."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", members)
    draw = random.Random(5)
    base, texts = [f"w{i % 200}" for i in range(300)], []
    for _ in range(60):
        w = list(base)
        for at in draw.sample(range(300), draw.randrange(1, 9)):
            w[at] = f"x{draw.randrange(40)}"
        texts.append(" ".join(w + w[:150] * draw.randrange(2)))
    label = {i: i - i % 3 if i < 12 else i for i in range(60)}  # some are joined before
    want = dict(label)
    for i in range(60):
        for j in range(i):
            m, n = bag(texts[i]), bag(texts[j])
            if sum((m & n).values()) >= 0.8 * sum((m | n).values()):
                x, y = want[i], want[j]
                want = {k: min(x, y) if v in (x, y) else v for k, v in want.items()}
    held = spark.createDataFrame([(1, i) for i in range(60)] + [(2, 3), (2, 4)], "key long, node long")
    known = spark.createDataFrame([(i, v) for i, v in label.items() if i < 12], "node long, label long")
    found = near_dedup.between(held, known, spark.createDataFrame(list(enumerate(texts)), "node long, text string"))
    to = {r["node"]: r["label"] for r in components(found).collect()}
    assert {i: to.get(v, v) for i, v in label.items()} == want
    assert 5 < len(set(want.values())) < 50


def test_near_dedup_classes(docs, none):
    rows = corpus()
    node = {i: n for n, i in enumerate(dict.fromkeys(r[0] for r in rows))}
    label = {i: i for i in node}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, t, *_ in rows:
        for j, u, *_ in rows:
            a, b = bag(t), bag(u)
            both = sum((a & b).values())
            if t == u or (both and both >= 0.8 * sum((a | b).values())):
                x, y = root(i), root(j)
                if x != y:
                    label[x] = y
    want = Counter(frozenset(i for i in node if root(i) == r) for r in {root(i) for i in node})
    got = {}
    for r in near_dedup.classes(docs).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    assert Counter(map(frozenset, got.values())) == want
    assert max(map(len, want)) >= 6
    assert near_dedup.classes(docs).count() == len(rows) and near_dedup.classes(none).count() == 0


def test_signatures_are_unbiased():
    a, b = "a b c d e f g h i j a b c d e f g h i j a b c d e q r s t u v w", "a b c d e f g h i j a b c d e f x h i j a b c d e q r s t u v z y"
    want = sum((bag(a) & bag(b)).values()) / sum((bag(a) | bag(b)).values())
    known, hits = near_dedup.WordHashes(), 0.0
    for i in range(200):
        renamed = [" ".join(f"{w}{i}" for w in t.split()) for t in (a, b)]
        s = near_dedup.signatures(2, *near_dedup.bags(renamed, known))
        hits += (s[0] == s[1]).mean()
    assert abs(hits / 200 - want) < 0.02


def test_components_of_a_chain_and_a_star(rows):
    links = rows("a long, b long", *[(i, i + 1) for i in range(20)], *[(100, i) for i in range(101, 140)], (7, 7))
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, **{i: 100 for i in range(101, 140)}}
    assert components(rows("a long, b long")).count() == 0


def test_fingerprints(docs, none):
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    pieces = lambda t: Counter(fingerprints.paragraphs(t))

    def like(a, b):
        every = sum((pieces(a) | pieces(b)).values())
        return sum((pieces(a) & pieces(b)).values()) / every if every else 1.0

    want = []
    for k, (i, t, *_) in enumerate(rows):
        t, u = t or "", rows[(k + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(t, e), 9), round(like(t, u), 9)))
    got = fingerprints.fingerprint(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) == sorted(want, key=str)
    texts = {r[0]: r[1] or "" for r in rows}
    prints = {}
    for r in got:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert fingerprints.fingerprint(none).count() == 0


def test_peeling_recovers_large_differences():
    a, b = [" ".join(f"line {i}\n" for i in range(3000))], [" ".join(f"line {i}\n" for i in range(1500, 4500))]
    got, differing = fingerprints.likeness(1, fingerprints.digests(a), fingerprints.digests(b))
    got = got[0]
    x, y = Counter(fingerprints.paragraphs(a[0])), Counter(fingerprints.paragraphs(b[0]))
    assert abs(got - sum((x & y).values()) / sum((x | y).values())) < 1e-12
    of = lambda t: set(fingerprints.digests(t)[1].tolist())
    found = {(int(k), int(s)) for _, keys, signs in differing for k, s in zip(keys, signs, strict=True)}
    assert {k for k, s in found if s > 0} == of(a) - of(b) and {k for k, s in found if s < 0} == of(b) - of(a)


def test_ids_that_fill_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_A_BUCKET", 10)
    data = [(None if i % 3 else 5 if i % 2 else i, f"text {i} " * (i % 9)) for i in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    ranges = fingerprints.in_buckets(docs)
    assert ranges.where("doc_id IS NULL AND NOT copy").select("bucket", "sub").distinct().count() > 10
    low = -(2**63)
    rows = sorted((r.doc_id if r.doc_id is not None else low, r.h, r.text) for r in docs.selectExpr("doc_id", "xxhash64(text) AS h", "text").collect())
    want = []
    for k, (_, _, t) in enumerate(rows):
        u = rows[(k + 1) % len(rows)][2]
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want.append((len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted((r.n_chars, r.edited_sha256) for r in fingerprints.fingerprint(docs).collect()) == sorted(want)


def test_differences_between_versions(rows):
    old = rows("doc_id long, text string, digest int", (1, "a\nb\nc", 0), (2, "same", 0), (3, None, 0), (4, "gone", 0))
    new = rows("doc_id long, text string", (1, "a\nx\nc\nc"), (2, "same"), (3, "came"), (5, ""))
    got = {}
    for r in fingerprints.difference(old, new).collect():
        got.setdefault(r.doc_id, set()).add((r.digest % 2**64, r.sign))
    of = lambda t: set(fingerprints.digests([t])[1].tolist())
    pairs = {1: ("a\nb\nc", "a\nx\nc\nc"), 3: ("", "came"), 4: ("gone", "")}
    assert got == {k: {(d, 1) for d in of(b) - of(a)} | {(d, -1) for d in of(a) - of(b)} for k, (a, b) in pairs.items()}


SAID = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "héllo </s>\\[INST]"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 1, "assistant", "b\\"), (2, 0, "system", "<<SYS>> \\\\ <|endoftext|>"),
    (3, 0, None, "x"), (4, 0, "assistant", "日本\U0001f600 " * 500), (5, 0, "assistant", "a"), (5, 0, "assistant", "a"), (None, 0, "assistant", "who"), (6, 0, "user", "[/INST[/INST]"),
]


def test_chat_reads_back(rows):
    df = rows("conv_id long, turn long, role string, text string", *SAID)
    got = {r.conv_id: r for r in chat.format_conversations(df).mapInArrow(chat.read_back, chat.READ).collect()}
    for conv in {r[0] for r in SAID}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in SAID if c == conv))
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 7
    assert chat.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "</s>", "<\\/s>", "\\\\</s>[INST]<s>\\", "<<SYS>>a<</SYS>>", "<<s>", "[/INST[/INST]", "<|endoftext|"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_shards_are_even_and_gapless(docs, none):
    payload = docs.selectExpr("doc_id", "crc32(coalesce(text, '')) AS crc")
    got = sharding.assign(payload, "doc_id", ["crc"], shards=7).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(corpus()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r.doc_id, r.crc) for r in got if r.doc_id is not None) == sorted((r[0], zlib.crc32((r[1] or "").encode())) for r in corpus() if r[0] is not None)
    assert sharding.assign(none.selectExpr("doc_id", "doc_id AS crc"), "doc_id", ["crc"]).count() == 0


def plain_ring(rows, nodes, caps):
    """Row by row: homes first, in ring order; then each that found its shard full goes on clockwise to one with room.

    rows: (cell, order, value); gives value -> (shard, slot).
    """
    cells, used, out, over = [c for c, _ in nodes], [0] * len(caps), {}, []
    home = lambda cell: next((i for i, c in enumerate(cells) if c >= cell), 0)
    for cell, _, value in sorted(rows):
        i = home(cell)
        s = nodes[i][1]
        if used[s] < caps[s]:
            out[value] = (s, used[s])
            used[s] += 1
        else:
            over.append((i, value))
    for i, value in over:
        while used[nodes[i][1]] >= caps[nodes[i][1]]:
            i = (i + 1) % len(nodes)
        s = nodes[i][1]
        out[value] = (s, used[s])
        used[s] += 1
    return out


@pytest.mark.parametrize(("shards", "load"), [(7, 1.0), (5, 1.25), (1, 1.0)])
def test_shards_against_a_plain_ring(spark, shards, load):
    from pyspark.sql import functions as F

    ids = spark.range(900).select((F.col("id") * 37 % 1000).alias("doc_id"), F.lit(1).alias("p"))
    h = F.xxhash64(F.lit("key"), "doc_id")
    held = [(r.cell, r.h, r.doc_id) for r in ids.select("doc_id", h.alias("h"), sharding.cell_of(h, 8).alias("cell")).collect()]
    nodes = sharding.ring(spark, shards, 8, 8)
    caps = sharding.capacities(900, shards, load)
    want = plain_ring(held, nodes, caps)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(ids, "doc_id", ["p"], shards=shards, vnodes=8, load=load, ring_bits=8).collect()}
    assert got == want


def test_shards_of_clashing_columns(rows):
    df = rows("run_cell long, run_lo long, run_shard long, shard long, slot long, ring_hash long", *[(i, i, 0, 1, 2, 3) for i in range(20)], (None, None, None, None, None, None))
    out = sharding.assign(df, "run_cell", ["run_lo", "run_shard", "shard", "slot", "ring_hash"], shards=3)
    assert out.columns == ["run_cell", "run_lo", "run_shard", "shard", "slot", "ring_hash", "_shard", "_slot"] and out.count() == 21
    assert {r["_shard"] for r in out.collect()} == {0, 1, 2} and {r.shard for r in out.collect()} == {1, None}


def test_slack_keeps_most_keys_in_place(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id").withColumn("p", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0))
    at = lambda n: {r.doc_id: r.shard for r in sharding.assign(ids, "doc_id", ["p"], shards=n, load=1.25).collect()}
    ten, eleven = at(10), at(11)
    assert max(Counter(ten.values()).values()) <= 500
    assert sum(ten[i] != eleven[i] for i in ten) < 4000 * 0.35


def spans(text):
    t = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(a, k, e) for a, _, k, e in sorted(out)]


KEPT = [
    (1, 'é\U0001f600 password = "hunter22" and TOKEN:abc'), (2, "secret=token:abcdefg"), (3, "AKIA" + "A" * 16 + " AKIAB " + "0123456789abcdef" * 2), (4, "api_key='AKIA" + "Z" * 20 + "'"), (5, None),
    (6, ""), (7, "x" * 50000 + " passwd: " + "deadbeef" * 8), (8, "secret=token:abcdefg"), (8, "secret=token:abcdefg"), (None, "apiKEY=" + "q" * 9), (9, "token=" * 30 + "abcdef1"),
]


def test_secrets_and_their_ledger(rows):
    df = rows("doc_id long, text string", *KEPT)
    found, ledger = secrets.scan(df)
    got = sorted(((r.doc_id, [(s.start, s.kind, s.end) for s in r.spans]) for r in found.collect()), key=str)
    assert got == sorted(((i, spans(t)) for i, t in KEPT), key=str)
    n = ledger.count()
    assert n == len({t or "" for _, t in KEPT})
    more = df.unionByName(rows("doc_id long, text string", (20, "token: brandnew1")))
    assert secrets.unseen(more, ledger).count() == 1
    again, grown = secrets.scan(more, ledger)
    assert grown.count() == n + 1 and again.count() == len(KEPT) + 1
    assert secrets.scan(df.limit(0))[0].count() == 0


def test_redaction_leaves_no_secret(rows):
    df = rows("doc_id long, text string, blob string, spans int", *[(i, t, "b", 1) for i, t in KEPT])
    out = secrets.redact(df, secrets.scan(df)[1])
    want = []
    for i, t in KEPT:
        at, kept = 0, ""
        for a, _, e in spans(t):
            kept += (t[at:a] + "[SECRET]") if a >= at else ""
            at = max(at, e)
        want.append((i, None if t is None else kept + t[at:]))
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
