"""Hashed words and word runs of texts, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

KINDS = {"body": pa.int64(), "identifiers": pa.int64(), "signature": pa.int64(), "control": pa.int32(), "sketch": pa.int64()}
FEATURES = ", ".join(f"{name} array<{'int' if kind == pa.int32() else 'long'}>" for name, kind in KINDS.items())
#: Odd multipliers for a token's place in a run of one, of two and of three tokens (arithmetic modulo 2**64).
PLACES = ((0x9E3779B97F4A7C15,), (0xD1B54A32D192ED03, 0xC2B2AE3D27D4EB4F), (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xBF58476D1CE4E5B9))
#: What is inside words, as `\w` is defined for Unicode; letters and numbers are, but for some numbers.
WORD = r"\p{Alphabetic}\p{Mn}\p{Me}\p{Mc}\p{Nd}\p{Pc}‌‍"
EDGES = regex.compile(rf"^[^{WORD}]+|[^{WORD}]+$")
ODD = r"^[^\p{L}\p{Nd}_]|[^\p{L}\p{Nd}_]$"
ASCII_EDGES = "".join(c for c in map(chr, range(128)) if not (c.isalnum() or c == "_"))
#: Words of 64 bits in the sketches of body, identifiers and signature.
SKETCH = (2, 1, 1)
#: Cells, as a power of 2, in which hashes are counted: those that begin with the same bits.
CELL_BITS = 20
#: Texts or lists that a worker makes anything of at once, and sends off.
HELD = 128


def in_slices(of: Callable[[pa.RecordBatch], list[pa.Array]], names: list[str]) -> Callable:
    """For mapInArrow: `of` some rows of a batch at a time, so that what is made of it never meets in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, HELD):
                yield pa.RecordBatch.from_arrays(of(batch.slice(i, HELD)), names)

    return run


def bare(tokens: pa.Array) -> np.ndarray:
    """Tokens without what surrounds their words."""
    trimmed = pc.ascii_trim(tokens, ASCII_EDGES)
    words = trimmed.to_numpy(zero_copy_only=False)
    wide = np.flatnonzero(~pc.string_is_ascii(trimmed).to_numpy(zero_copy_only=False))
    odd = wide[pc.match_substring_regex(trimmed.take(pa.array(wide)), ODD).to_numpy(zero_copy_only=False)]
    words[odd] = [EDGES.sub("", words[i]) for i in odd]
    return words


def hashed(words: np.ndarray) -> np.ndarray:
    return hash_array(words, categorize=False)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Each hash once, ascending."""
    hashes = np.sort(hashes.view(np.int64))
    return hashes[np.append(True, hashes[1:] != hashes[:-1])] if len(hashes) else hashes


def mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n."""
    last = max(len(hashes) - n + 1, 0)
    return sum(hashes[i : last + i] * np.uint64(m) for i, m in enumerate(PLACES[n - 1]))


def cell(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - CELL_BITS).cast("int")


def by_rarity(rows: DataFrame, hashes: str, first: str, counts: np.ndarray) -> DataFrame:
    """`rows` with `shingles` instead of these two columns: the `first` so many of ascending `hashes` by rising counts of
    their cells; and the `rarest` whose count is above 1, if any: below that no one else has it."""
    kept = [c for c in rows.columns if c not in (hashes, first)]

    def order(own: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        held = counts[own.view(np.uint64) >> np.uint64(64 - CELL_BITS)]
        order = held.argsort(kind="stable")
        shared = order[held[order].searchsorted(2) :][:1]
        return own[shared], own[order[:m]]

    def of(batch: pa.RecordBatch) -> list[pa.Array]:
        ends, values = batch[hashes].offsets.to_numpy(), batch[hashes].values.to_numpy()
        found = [order(values[a:b], m) for a, b, m in zip(ends[:-1].tolist(), ends[1:].tolist(), batch[first].to_pylist(), strict=True)]
        return [*(batch[c] for c in kept), *(listed([x[i] for x in found], KINDS["body"]) for i in range(2))]

    schema = StructType([rows.schema[c] for c in kept])
    for name in ("rarest", "shingles"):
        schema = schema.add(name, ArrayType(LongType()))
    return rows.mapInArrow(in_slices(of, schema.names), schema)


def listed(lists: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, kind.to_pandas_dtype()), *lists])))


def parities(lists: pa.Array, words: int) -> np.ndarray:
    """Parities of each list's hashes by 64 * words bits."""
    ends, hashes = lists.offsets.to_numpy(), np.append(lists.values.to_numpy(), 0).view(np.uint64)
    bits, own = np.uint64(1) << (hashes & np.uint64(63)), (hashes >> np.uint64(6)) % np.uint64(words)
    bits[-1] = 0
    found = np.stack([np.bitwise_xor.reduceat(np.where(own == i, bits, np.uint64(0)), ends[:-1]) for i in range(words)], axis=1)
    return np.where(np.diff(ends)[:, None] > 0, found, np.uint64(0)).view(np.int64)


def features(rows: DataFrame, id_: str, lowered: Column, control: tuple[str, ...], ignored: tuple[str, ...]) -> DataFrame:
    """(id, body, identifiers, signature, control, sketch): hashed runs of three tokens of a lower-case text and of its first
    line, its distinct words but the `ignored` ones, how often it has each of `control` and question marks, and parities of
    the first three. Fewer tokens than three are one run, none are none."""
    counted, left_out = hashed(np.array(control, object)), hashed(np.array([*ignored, ""], object))
    order = counted.argsort()

    def of(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = pc.ascii_trim_whitespace(batch["_text"])
        split, plain = pc.ascii_split_whitespace(texts), texts.cast(pa.binary()).to_pylist()
        ends, tokens = split.offsets.to_numpy().tolist(), split.values.dictionary_encode()
        ids, once = tokens.indices.to_numpy(), hashed(bare(tokens.dictionary))
        hashes = hashed(tokens.dictionary.to_numpy(zero_copy_only=False))[ids]
        words, kept, told = once[ids], ~np.isin(once, left_out)[ids], np.isin(once, counted)[ids]
        three = mixed(hashes, 3)

        def runs(start: int, n: int) -> np.ndarray:
            return distinct(three[start : start + n - 2] if n > 2 else mixed(hashes[start : start + n], max(n, 1)))

        out = [], [], [], []
        for i, text in enumerate(plain):
            start, end = (ends[i], ends[i + 1]) if text else (0, 0)
            own, line = words[start:end], text.split(b"\n", 1)[0].split(b"\r", 1)[0]
            times = np.bincount(order[counted.searchsorted(own[told[start:end]], sorter=order)], minlength=len(control) + 1)
            times[-1] = text.count(b"?")
            out[0].append(runs(start, end - start))
            out[1].append(distinct(own[kept[start:end]]))
            out[2].append(out[0][-1] if line == text else runs(start, len(line.split())))
            out[3].append(times.astype(np.int32))
        made = [listed(x, kind) for x, kind in zip(out, KINDS.values(), strict=False)]
        sketches = np.concatenate([parities(x, n) for x, n in zip(made, SKETCH, strict=False)], axis=1)
        return [batch[id_], *made, listed(list(sketches), KINDS["sketch"])]

    schema = StructType([rows.schema[id_], *StructType.fromDDL(FEATURES)])
    return rows.select(id_, lowered.alias("_text")).mapInArrow(in_slices(of, schema.names), schema)
