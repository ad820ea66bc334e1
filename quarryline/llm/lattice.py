"""Segmentation lattices of text units over a fixed public vocabulary.

A space stands for the vocabulary's word mark. No piece holds a space after
another character, nor a line feed, so that the lattice of a text is the
product of the lattices of its units: a run of spaces with the word behind it,
or a line feed. Characters outside the vocabulary are spelt in byte pieces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
_units = re.compile(r" *[^ \n]+| +|\n").findall


def units_of(text: str) -> list[str]:
    """The units of a text, with the space that the encoder puts in front."""
    return _units(f" {text}") if text else []


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id (None: control pieces), the ids of the 256 byte pieces, and log weights by rank."""

    pieces: list
    byte_ids: list
    log_weight: np.ndarray

    @classmethod
    def load(cls, path: str = PIECES) -> Vocabulary:
        """Of a SentencePiece model file; piece r of the ranking weighs 1/(r+1), bytes as the last."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        spelt = [sp.is_byte(i) for i in range(n)]
        pieces = [None if sp.is_control(i) or sp.is_unknown(i) or spelt[i] else sp.id_to_piece(i).replace("▁", " ") for i in range(n)]
        at = {sp.id_to_piece(i): i for i in range(n) if spelt[i]}
        score = np.array([sp.get_score(i) if pieces[i] is not None else -np.inf for i in range(n)])
        rank = np.empty(n)
        rank[np.argsort(-score, kind="stable")] = np.arange(n)
        weight = np.where([p is not None for p in pieces], 1 / (rank + 1), 1 / n)
        weight[[i for i in range(n) if pieces[i] is None and not spelt[i]]] = 0
        with np.errstate(divide="ignore"):
            return cls(pieces, [at[f"<0x{b:02X}>"] for b in range(256)], np.log(weight / weight.sum()))

    def trie(self) -> Trie:
        return Trie([(p, i) for i, p in enumerate(self.pieces) if p is not None])


class Trie:
    """Prefixes of the pieces as states of a hashed table, for matching at many places at once."""

    bits = 18

    def __init__(self, pieces: list[tuple[str, int]]):
        states, edges = {"": 0}, {}
        for p, _ in pieces:
            for j in range(1, len(p) + 1):
                if p[:j] not in states:
                    states[p[:j]] = len(states)
                    edges[states[p[: j - 1]], ord(p[j - 1])] = states[p[:j]]
        self.piece = np.full(len(states), -1, np.int32)
        self.piece[[states[p] for p, _ in pieces]] = [i for _, i in pieces]
        self.inner = np.zeros(len(states), bool)
        self.inner[[s for s, _ in edges]] = True
        self.first = np.full(0x110000, -1, np.int32)  # the states behind the start, by character
        for (s, c), child in edges.items():
            if not s:
                self.first[c] = child
        while 3 * len(edges) > 1 << self.bits:
            self.bits += 1
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.child = np.full(1 << self.bits, -1, np.int32)
        keys = np.array([(s << 21) + c for s, c in edges], np.int64)
        children, slot = np.array(list(edges.values()), np.int32), self.slot(keys)
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            first = first[self.key[slot[first]] < 0]
            self.key[slot[first]], self.child[slot[first]] = keys[first], children[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, children, slot = keys[rest], children[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The states behind `states` by `chars`; -1 where no piece goes on so."""
        keys = (states.astype(np.int64) << 21) + chars
        slot = self.slot(keys)
        held = self.key[slot]
        out = np.where(held == keys, self.child[slot], np.int32(-1))
        miss = np.flatnonzero((held != keys) & (held >= 0))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & ((1 << self.bits) - 1)
            held = self.key[slot[miss]]
            hit = held == keys[miss]
            out[miss[hit]] = self.child[slot[miss[hit]]]
            miss = miss[~hit & (held >= 0)]
        return out


class Lattices:
    """The lattices of many units at once, in flat arrays.

    A unit of n characters has n + 1 nodes; `first[u]` is its first. Edges are
    sorted by their start node, and node v's edges are `lo[v]` to `lo[v + 1]`.
    A piece id of `size` or more is character `piece - size` of `spelt`.
    """

    def __init__(self, units: list[str], trie: Trie, size: int, spelt: dict[str, int]):
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        self.first = np.concatenate([[0], np.cumsum(lengths + 1)])
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.int32)
        owner = np.repeat(np.arange(len(units), dtype=np.int32), lengths)
        node = np.arange(len(chars), dtype=np.int32) + owner  # of each character
        left = np.repeat(np.cumsum(lengths).astype(np.int32), lengths) - np.arange(len(chars), dtype=np.int32)  # characters to the end
        start, depth = np.arange(len(chars), dtype=np.int32), 0
        starts, pieces, state = [], [], None
        while len(start):
            state = trie.first[chars] if state is None else trie.step(state, chars[start + depth])
            piece = trie.piece[state]  # of a state -1: the last of all, not used
            if not depth:
                strange = (state < 0) | (piece < 0)
                for c in np.unique(chars[strange]).tolist():
                    spelt.setdefault(chr(c), len(spelt))
                piece[strange] = [size + spelt[chr(c)] for c in chars[strange].tolist()]
                found = np.ones(len(chars), bool)
            else:
                found = (state >= 0) & (piece >= 0)
            starts.append(start[found])
            pieces.append(piece[found])
            depth += 1
            going = (state >= 0) & trie.inner[state] & (left[start] > depth)
            start, state = start[going], state[going]
        # edges by start, then length: each depth puts its edges behind those of the depths before
        degree = np.zeros(self.first[-1], np.int32)
        for at in starts:
            degree[node[at]] += 1
        self.lo = np.concatenate([[0], np.cumsum(degree)])
        self.start = np.repeat(np.arange(len(degree), dtype=np.int32), degree)
        self.end, self.piece = np.empty(self.lo[-1], np.int32), np.empty(self.lo[-1], np.int32)
        free = self.lo[:-1].copy()
        for depth, (at, piece) in enumerate(zip(starts, pieces, strict=True)):
            v = node[at]
            slot = free[v]
            self.end[slot], self.piece[slot] = v + (depth + 1), piece
            free[v] += 1
        far = np.zeros(len(degree), np.int32)
        far[node] = left
        if far.max(initial=0) < 2**15:
            far = far.astype(np.int16)  # sorts in linear time
        far = far[self.start]
        order = np.argsort(far, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(far[order])) + 1) if len(order) else []

    def suffix_mass(self, log_p: np.ndarray) -> np.ndarray:
        """Per node, the log of the sum over all ways to its unit's end. log_p: by piece, and model."""
        beta = np.zeros((len(self.lo) - 1, *log_p.shape[1:]))
        for edges in self.levels:
            value = log_p[self.piece[edges]] + beta[self.end[edges]]
            node = self.start[edges]
            cut = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            top = np.maximum.reduceat(value, cut)
            total = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(cut, len(node))), axis=0)), cut)
            beta[node[cut]] = top + np.log(total)
        return beta

    def choice(self, log_p: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """Per edge, the log probability that a segmentation at its start goes on with it."""
        return log_p[self.piece] + beta[self.end] - beta[self.start]

    def visits(self, choice: np.ndarray) -> np.ndarray:
        """Per edge, the expected number of uses in one segmentation of its unit."""
        seen = np.zeros((len(self.lo) - 1, *choice.shape[1:]))
        seen[self.first[:-1]] = 1
        used = np.zeros_like(choice)
        for edges in reversed(self.levels):
            used[edges] = seen[self.start[edges]] * np.exp(choice[edges])
            np.add.at(seen, self.end[edges], used[edges])
        return used


def spell(log_p: np.ndarray, spelt: dict[str, int], byte_ids: list[int]) -> np.ndarray:
    """`log_p` with the characters in `spelt` behind it, each the sum of its bytes."""
    if not spelt:
        return log_p
    ids = np.array(byte_ids)
    return np.concatenate([log_p, np.array([log_p[ids[list(c.encode())]].sum(axis=0) for c in spelt])])
