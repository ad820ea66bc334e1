"""Distinct sampled segmentations by Gumbel top-k without replacement.

A segmentation's log probability is the sum of its pieces' log weights, less
the lattice's total. A best-first (A*) search runs over sets of segmentations
that share a prefix: a set's bound is its largest Gumbel-perturbed log
probability, which is known exactly from its mass, so that the first complete
segmentation that leaves the queue is the best of all that are left. Descending
from a set to its best member goes through all units of a chunk of texts at
once; the sets left beside the path, one a unit, enter the text's queue. The
k best are k draws without replacement; the bound that is left on the queue is
the threshold of their inclusion probabilities 1 - exp(-exp(log p - bound)).

Random numbers are hashes of the row's key, their purpose, the draw, the unit and
the step in it, hence no two alike, and the same under any partitioning and on
recomputation after a lost executor.

Decoding joins the pieces' bytes and drops the space in front; it gives back
every text exactly, whatever characters it holds.

Defined results: null and empty texts have one segmentation, without pieces; a
text with fewer than k segmentations yields them all; a null key is seeded by
the text; repeated rows yield the same draws; an empty table yields no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .lattice import PIECES, Lattices, Trie, Vocabulary, spell, units_of
from .shared import documents, fresh
from .words import chunks, spread

K = 2
CACHE = 90_000  # units; beyond it the third used most stays
LATTICE_CHARS = 60_000  # of units put in at a time
DRAWN = "draw int, ids array<int>, log_prob double, log_inclusion double"
CHUNK = 400_000


TRIES = ("try", "try again", "try once more")
PURPOSES = ("best", "descend", "beside", "where", "before", "after", "again", "leave", *TRIES)
GOLDEN, MASK = 0x9E3779B97F4A7C15, 2**64 - 1


def scramble(z: np.ndarray) -> np.ndarray:
    """The splitmix64 mixer."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def keyed(seeds: np.ndarray, purpose: str, draw: int, row: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """One random word for each (seed of the row, purpose, draw, unit): what is drawn there depends on no other."""
    tag = (1 + PURPOSES.index(purpose) + len(PURPOSES) * draw) * GOLDEN & MASK
    return scramble(scramble(seeds + np.uint64(tag))[row] + unit.astype(np.uint64) * np.uint64(GOLDEN))


def uniform(words: np.ndarray, step: int = 0) -> np.ndarray:
    """In (0, 1), one for each random word and step."""
    z = scramble(words + np.uint64((step + 1) * GOLDEN & MASK))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Tables:
    """Lattices of the units met so far, ready to draw from.

    Unit u has the nodes root[u] to root[u + 1], node v the edges lo[v] to
    lo[v + 1]. The number of a node changes no draw.
    """

    EDGES = ("end", "piece", "log_q", "upper")  # upper: the probability of this and all longer edges of its node

    def __init__(self, vocab: Vocabulary, trie: Trie):
        self.vocab, self.trie, self.size = vocab, trie, len(vocab.pieces)
        self.ids, self.spelt = {}, {}
        self.units = self.nodes = self.edges = 0
        self.root, self.lo, self.used = np.zeros(1, np.int64), np.zeros(1, np.int32), np.zeros(0, np.int64)
        self.end, self.piece = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.log_q, self.upper = np.zeros(0), np.zeros(0)

    def room(self, name: str, n: int) -> np.ndarray:
        """The array of that name with room for n, half as much again if it has to grow."""
        old = getattr(self, name)
        if len(old) < n:
            new = np.zeros(n + n // 2, old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)
        return getattr(self, name)

    def numbers(self, units: list[str]) -> np.ndarray:
        """The numbers of units; those not met before are put in."""
        if len(self.ids) > CACHE:
            self.keep(CACHE // 3)
        out = np.fromiter(map(self.ids.get, units, repeat(-1)), np.int64, len(units))
        met = np.flatnonzero(out < 0).tolist()
        new = list(dict.fromkeys(map(units.__getitem__, met)))
        self.ids.update(zip(new, range(self.units, self.units + len(new)), strict=True))
        out[met] = [self.ids[units[i]] for i in met]
        for some in chunks([len(u) for u in new], LATTICE_CHARS):
            self.add(new[some])
        self.room("used", self.units)
        self.used[: self.units] += np.bincount(out, minlength=self.units)
        return out

    def add(self, units: list[str]) -> None:
        lat = Lattices(units, self.trie, self.size, self.spelt)
        log_p = spell(self.vocab.log_weight, self.spelt, self.vocab.byte_ids)
        log_q = lat.choice(log_p, lat.suffix_mass(log_p))
        upper, last, degree = np.exp(log_q), lat.lo[1:] - 1, np.diff(lat.lo)
        for j in range(1, degree.max(initial=0)):  # sums over a node's own edges alone
            last, degree = last[degree > j], degree[degree > j]
            upper[last - j] += upper[last - j + 1]
        u, v, e = self.units, self.nodes, self.edges
        self.units, self.nodes, self.edges = u + len(units), v + len(lat.lo) - 1, e + len(lat.end)
        self.room("root", self.units + 1)[u : self.units + 1] = lat.first + v
        self.room("lo", self.nodes + 1)[v : self.nodes + 1] = lat.lo + e
        for name, x in zip(self.EDGES, (lat.end + v, lat.piece, log_q, upper), strict=True):
            self.room(name, self.edges)[e : self.edges] = x

    def keep(self, n: int) -> None:
        """Forgets all but the n units that were used most."""
        names = list(self.ids)
        kept = np.sort(np.argsort(-self.used[: self.units], kind="stable")[:n])
        self.ids, self.used = {names[i]: n for n, i in enumerate(kept.tolist())}, self.used[kept] // 2
        first, sizes = self.root[kept], self.root[kept + 1] - self.root[kept]
        unit, step = spread(sizes)
        nodes, root = first[unit] + step, np.concatenate([[0], np.cumsum(sizes)])
        degree = self.lo[nodes + 1] - self.lo[nodes]
        node, step = spread(degree)
        edges = self.lo[nodes][node] + step
        moved = (root[:-1] - first)[unit][node]
        self.end, self.piece, self.log_q, self.upper = self.end[edges] + moved.astype(np.int32), self.piece[edges], self.log_q[edges], self.upper[edges]
        self.lo, self.root = np.concatenate([[0], np.cumsum(degree)]).astype(np.int32), root
        self.units, self.nodes, self.edges = len(kept), len(nodes), len(edges)

    def descend(self, nodes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each start node, by its random word, a drawn way to its end: edges laid end to end, their counts, log probabilities."""
        log_q, counts, steps = np.zeros(len(nodes)), np.zeros(len(nodes), np.int64), []
        at = np.argsort(nodes, kind="stable")  # reads of neighbours follow each other
        node, word = nodes[at], words[at]
        while len(at):
            u, edge, first = uniform(word, len(steps)), self.lo[node + 1] - 1, self.lo[node]
            # from the longest edge, which is the likeliest, down to the one that u falls on
            open_ = np.flatnonzero((self.upper[edge] <= u) & (edge > first))
            while len(open_):
                edge[open_] -= 1
                e = edge[open_]
                open_ = open_[(self.upper[e] <= u[open_]) & (e > first[open_])]
            log_q[at] += self.log_q[edge]
            counts[at] += 1
            steps.append((at, edge))
            node = self.end[edge]
            going = self.lo[node + 1] > self.lo[node]
            at, node, word = at[going], node[going], word[going]
        offset = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), np.int32)
        for i, (at, edge) in enumerate(steps):
            out[offset[at] + i] = edge
        return out, counts, log_q

    def other(self, root: int, taken: list[list[int]], word: np.ndarray) -> list[int]:
        """A way from `root` drawn, by a random word, from all but those `taken`."""
        path, node = [], root
        while True:
            a, b = int(self.lo[node]), int(self.lo[node + 1])
            if a == b:
                return path
            rest = [math.exp(x) for x in self.log_q[a:b].tolist()]
            for t in taken:  # less what is taken behind its next edge
                rest[t[len(path)] - a] -= math.exp(sum(self.log_q[x] for x in t[len(path) :]))
            rest = [max(x, 0.0) for x in rest]
            if not sum(rest):  # rounding left nothing: any edge that isn't the end of a taken way
                rest = [float(all(t[len(path)] != e or len(t) > len(path) + 1 for t in taken)) for e in range(a, b)]
            e, u = a, float(uniform(word, len(path))[0]) * sum(rest)
            while e + 1 < b and u >= rest[e - a]:
                u -= rest[e - a]
                e += 1
            while not rest[e - a]:
                e -= 1
            taken = [t for t in taken if t[len(path)] == e]
            path.append(e)
            node = int(self.end[e])

    def pieces_of(self, edges: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of ways laid end to end, and their lengths; characters outside the vocabulary are spelt in bytes."""
        piece = self.piece[edges]
        odd = piece >= self.size
        if not odd.any():
            return piece, lengths
        spelt = [self.vocab.byte_ids[b] for c in self.spelt for b in c.encode()]
        size = np.array([len(c.encode()) for c in self.spelt])
        count = np.ones(len(piece), np.int64)
        count[odd] = size[piece[odd] - self.size]
        out, which = np.repeat(piece, count), np.repeat(odd, count)
        _, step = spread(count[odd])
        out[which] = np.array(spelt)[np.repeat((np.cumsum(size) - size)[piece[odd] - self.size], count[odd]) + step]
        ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(lengths)])]
        return out, np.diff(ends)


class Draw:
    """One segmentation of one text: its edges, the units' bounds in them, log probabilities and their sums up to each unit."""

    __slots__ = ("bounds", "edges", "log_q", "upto")

    def __init__(self, edges: np.ndarray, bounds: np.ndarray, log_q: np.ndarray, upto: np.ndarray):
        self.edges, self.bounds, self.log_q, self.upto = edges, bounds, log_q, upto

    def way(self, unit: int) -> list[int]:
        return self.edges[self.bounds[unit] : self.bounds[unit + 1]].tolist()

    def branch(self, unit: int, way: list[int], log_q: float, tail: Draw) -> Draw:
        """The draw that leaves this one at `unit`, by `way` and then `tail`."""
        head = self.edges[: self.bounds[unit]]
        edges = np.concatenate([head, np.array(way, np.int32), tail.edges])
        upto = np.concatenate([self.upto[: unit + 1], tail.upto + (self.upto[unit] + log_q)])
        return Draw(edges, np.concatenate([self.bounds[: unit + 1], tail.bounds + len(head) + len(way)]), np.concatenate([self.log_q[:unit], [log_q], tail.log_q]), upto)


@dataclass
class Leaving:
    """The set of segmentations that leave a draw's path at a unit in [lo, hi); or at lo, by none of the `taken` ways."""

    bound: float  # its largest perturbed log probability
    draw: Draw
    lo: int
    hi: int
    taken: list[list[int]] | None = None


def rest_of(log_q: float) -> float:
    """log(1 - q); none is left where rounding alone keeps q from 1."""
    return -math.inf if log_q > -1e-12 else math.log(-math.expm1(log_q))


def beside(mass: float, top: float, u: float) -> float:
    """Largest perturbed log probability of a set of this log mass, given that it lies below `top`."""
    if mass == -math.inf:
        return mass
    far = mass - top
    return top if far > 700 else mass - math.log(-math.log(u) + math.exp(far))


def leaving(draw: Draw, lo: int, hi: int, top: float, u: float) -> list[Leaving]:
    """The set of those that leave `draw` at a unit in [lo, hi), if there are any."""
    bound = beside(float(draw.upto[lo]) + rest_of(float(draw.upto[hi] - draw.upto[lo])), top, u) if lo < hi else -math.inf
    return [Leaving(bound, draw, lo, hi)] if bound > -math.inf else []


def leaves_at(found: Leaving, u: float) -> int:
    """At which unit the best member of a set leaves: drawn by the masses of those that leave there."""
    upto = found.draw.upto
    left = upto[found.lo] + math.log1p(u * math.expm1(min(upto[found.hi] - upto[found.lo], 0.0)))
    s = found.lo + int(np.searchsorted(-upto[found.lo + 1 : found.hi + 1], -left, side="left"))
    s = min(s, found.hi - 1)
    while s > found.lo and not found.draw.log_q[s] < -1e-12:  # rounding chose a unit with one way only
        s -= 1
    return s


def draw_chunk(tables: Tables, split: list[list[str]], seeds: np.ndarray, k: int) -> list[list[tuple]]:
    """Per text its draws (edges, log probability, log inclusion), best first."""
    counts = np.array([len(s) for s in split], np.int64)
    unit = tables.numbers([u for s in split for u in s])
    firsts = np.cumsum(counts) - counts

    def words(purpose: str, draw: int, rows: np.ndarray, units: np.ndarray | None = None) -> np.ndarray:
        return keyed(seeds, purpose, draw, rows, np.zeros(len(rows), np.int64) if units is None else units)

    which, since = np.arange(len(split)), np.zeros(len(split), np.int64)
    tops = (-np.log(-np.log(uniform(words("best", 0, which))))).tolist()
    draws: list[list[Draw]] = [[] for _ in split]
    queues: list[list[Leaving]] = [[] for _ in split]
    branches: list[tuple | None] = [None] * len(split)
    for i in range(k):
        # complete the best members: all units behind the one where they leave, of all texts at once
        job, step = spread(counts[which] - since)
        place, row = since[job] + step, which[job]
        edges, lengths, log_q = tables.descend(tables.root[unit[firsts[row] + place]], words("descend", i, row, place))
        ends, cuts = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(counts[which] - since)]).tolist()
        u = {p: uniform(words(p, i, which)).tolist() for p in ("beside", "where", "before", "after", "again")}
        best = []
        for j, d in enumerate(which.tolist()):
            a, b = cuts[j], cuts[j + 1]
            tail = Draw(edges[ends[a] : ends[b]], ends[a : b + 1] - ends[a], log_q[a:b], np.append(0.0, np.cumsum(log_q[a:b])))  # sums that other texts don't touch
            new = tail if branches[j] is None else branches[j][0].branch(*branches[j][1:], tail)
            draws[d].append(new)
            queue = queues[d]
            queue += leaving(new, int(since[j]), int(counts[d]), tops[d], u["beside"][j])
            if i + 1 < k and queue:
                # the best set leaves the queue, and is split at the unit where its best member leaves
                found = max(queue, key=lambda x: x.bound)
                queue.remove(found)
                tops[d] = found.bound
                s = found.lo
                if found.taken is None:
                    s = leaves_at(found, u["where"][j])
                    queue += leaving(found.draw, found.lo, s, found.bound, u["before"][j]) + leaving(found.draw, s + 1, found.hi, found.bound, u["after"][j])
                best.append((j, d, s, found.draw, found.taken or [found.draw.way(s)]))
        ways = new_ways(tables, [(int(tables.root[unit[firsts[d] + s]]), taken) for _, d, s, _, taken in best], lambda p, at: words(p, i, np.array([best[x][1] for x in at])))
        branches = []
        for (j, d, s, draw, taken), way in zip(best, ways, strict=True):
            taken = [*taken, way]
            gone = math.log(sum(math.exp(tables.log_q[t].sum()) for t in taken))
            bound = beside(float(draw.upto[s]) + rest_of(gone), tops[d], u["again"][j])
            if bound > -math.inf:
                queues[d].append(Leaving(bound, draw, s, s + 1, taken))
            branches.append((draw, s, way, float(tables.log_q[way].sum())))
        which, since = np.array([x[1] for x in best], np.int64), np.array([x[2] + 1 for x in best], np.int64)
        if not best:
            break
    out = []
    for mine, queue in zip(draws, queues, strict=True):
        rows, left = [], max((x.bound for x in queue), default=-math.inf)
        for x in mine:
            p = float(x.log_q.sum())
            rate = p - left
            rows.append((x.edges, p, rate if rate < -30 else float(np.log(-np.expm1(-np.exp(min(rate, 700.0)))))))
        out.append(rows)
    return out


def new_ways(tables: Tables, wanted: list[tuple[int, list]], words) -> list[list[int]]:
    """For each (root, taken ways) a way drawn from all others: draws that hit a taken one are drawn again,
    a few times for all at once, then exactly."""
    out: list[list[int] | None] = [None] * len(wanted)
    open_ = list(range(len(wanted)))
    for purpose in TRIES:
        if open_:
            edges, lengths, _ = tables.descend(np.array([wanted[x][0] for x in open_], np.int64), words(purpose, open_))
            ends = np.cumsum(lengths).tolist()
            for x, a, b in zip(open_, [0, *ends], ends, strict=False):
                way = edges[a:b].tolist()
                if way not in wanted[x][1]:
                    out[x] = way
            open_ = [x for x in open_ if out[x] is None]
    if open_:
        for x, word in zip(open_, words("leave", open_), strict=True):
            out[x] = tables.other(*wanted[x], np.array([word]))
    return out


def spelling(vocab: Vocabulary) -> list[bytes]:
    """Piece id -> its bytes."""
    spelt = [p.encode() if p is not None else b"" for p in vocab.pieces]
    for b, i in enumerate(vocab.byte_ids):
        spelt[i] = bytes([b])
    return spelt


def spell_out(ids: pa.ListArray, spelt: pa.Array) -> pa.Array:
    """The bytes that lists of piece ids spell, with the space in front of a text; null stays null."""
    return pa.compute.binary_join(pa.ListArray.from_arrays(ids.offsets, spelt.take(ids.values), mask=ids.is_null()), b"")


def encoder(vocab: Vocabulary, k: int, check: bool):
    trie = vocab.trie()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, spelt = Tables(vocab, trie), pa.array(spelling(vocab), pa.binary())
        for batch in batches:
            texts, keys = batch["text"], batch["key"]
            for part in chunks(pa.compute.utf8_length(texts).fill_null(0).to_pylist(), CHUNK):
                own = [t or "" for t in texts[part].to_pylist()]
                seeds = np.array([xxhash.xxh3_64_intdigest(f"k{key}" if key is not None else f"t{t}") for key, t in zip(keys[part].to_pylist(), own, strict=True)], np.uint64)
                drawn = draw_chunk(tables, [units_of(t) for t in own], seeds, k)
                row = pa.array(np.repeat(np.arange(len(own)), [len(d) for d in drawn]))
                flat = [x for d in drawn for x in d]
                ids, n = tables.pieces_of(np.concatenate([x[0] for x in flat]), np.array([len(x[0]) for x in flat]))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                cols = [keys[part].take(row), pa.array(np.concatenate([np.arange(len(d)) for d in drawn]).astype(np.int32)), lists]
                cols += [pa.array([x[i] for x in flat], pa.float64()) for i in (1, 2)]
                if check:
                    whole = pa.array([f" {t}" if t else "" for t in own], pa.string()).cast(pa.binary())
                    cols.append(pa.compute.equal(spell_out(lists, spelt), whole.take(row)))
                yield pa.RecordBatch.from_arrays(cols, ["key", "draw", "ids", "log_prob", "log_inclusion", *["round_trip"] * check])

    return run


def encode(df: DataFrame, key: str = "doc_id", k: int = K, pieces: str = PIECES, check: bool = False) -> DataFrame:
    """`key` and, per draw, its piece ids, log probability and log inclusion score (with underscores in front where `key` has
    such a name); if `check`, whether they decode to the text."""
    rows = df.select(F.col(key).alias("key"), "text")
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(encoder(Vocabulary.load(pieces), k, check), f"key {kind}, {DRAWN}" + ", round_trip boolean" * check)
    return out.toDF(key, *fresh(df.select(key), *out.columns[1:]))


def decode(df: DataFrame, pieces: str = PIECES, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the text that the piece ids spell."""
    spelling_ = spelling(Vocabulary.load(pieces))
    (name,) = fresh(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt = pa.array(spelling_, pa.binary())
        for batch in batches:
            whole = spell_out(batch.column(batch.schema.get_field_index(ids)), spelt)
            texts = pa.compute.utf8_slice_codeunits(whole.cast(pa.string()), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(name, StringType()))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = encode(documents(spark, sf_dir).select("doc_id", "text"), check=True)
    return drawn.select("doc_id", "draw", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"), "log_prob", "log_inclusion", "round_trip")
