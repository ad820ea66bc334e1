"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the
sorted spans of its assistant texts are intersected with the token spans by
binary search, which gives the loss mask.

Template, for each turn in order: `[INST]` role `[/INST]` text `</s>`. In roles
and texts a backslash is doubled, and a control string gets one after its first
character, so that no control string is left inside; taking away one backslash
from each pair, and every single one, undoes it. The control strings are single
tokens of the encoder, so that no token lies across the border of a text.

Defined results: a null role or text is empty; turns are ordered by turn (null
first), then role and text; repeated rows are turns of their own; rows of a
null conv_id form one conversation; an empty table yields no rows. Other
columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed values.
OPEN, MID, END = "[INST]", "[/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
TRAINED = "assistant"
FORMATTED = "conv_id long, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"

_control = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))


def escape(text: str) -> str:
    return _control.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts that are trained on."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{MID}", escape(text)
        if role == TRAINED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    turns = []
    for turn in formatted.split(END)[:-1]:
        role, text = turn[len(OPEN):].split(MID)
        turns.append((unescape(role), unescape(text)))
    return turns


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens [start, end) lie in one of the sorted spans."""
    if not spans:
        return np.zeros(len(starts), bool)
    lo, hi = np.array(spans).T
    i = np.searchsorted(lo, starts, side="right") - 1
    return (i >= 0) & (ends <= hi[i]) & (ends > starts)


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The characters under the mask, each once: a character may be several tokens."""
    s, e = starts[mask], ends[mask]
    if not len(s):
        return ""
    s = np.maximum(s, np.concatenate([[0], np.maximum.accumulate(e)[:-1]]))
    cut = np.flatnonzero(s[1:] != e[:-1]) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(s)]]) - 1
    return unescape("".join(formatted[a:b] for a, b in zip(s[first].tolist(), e[last].tolist(), strict=True)))


def formatter(vocabulary: str):
    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Rows come sorted by conversation; one may go on in the next batch."""
        last, turns = None, []
        for batch in batches:
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if turns and conv != last:
                    yield last, turns
                    turns = []
                last = conv
                turns.append((role or "", text or ""))
        if turns:
            yield last, turns

    def flush(tok, group: list) -> pa.RecordBatch:
        drawn = [render(t) for _, t in group]
        codes = tok.encode_batch([d[0] for d in drawn], add_special_tokens=False)
        cols = [[c for c, _ in group], [len(t) for _, t in group], [d[0] for d in drawn], [], [], [], []]
        for code, (_, spans) in zip(codes, drawn, strict=True):
            starts, ends = np.array(code.offsets, np.int32).reshape(-1, 2).T
            for col, x in zip(cols[3:], (np.array(code.ids, np.int32), starts, ends, loss_mask(starts, ends, spans)), strict=True):
                col.append(x)
        ints = [pa.array(c, pa.list_(pa.int32())) for c in cols[3:6]]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), *ints, pa.array(cols[6], pa.list_(pa.bool_()))], ["conv_id", "n_turns", "formatted", "ids", "starts", "ends", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import AddedToken, Tokenizer, processors

        tok = Tokenizer.from_str(vocabulary)
        tok.post_processor = processors.ByteLevel(trim_offsets=False)
        tok.add_special_tokens([AddedToken(c, normalized=False) for c in CONTROL])
        group, size = [], 0
        for conv, turns in conversations(batches):
            group.append((conv, turns))
            size += sum(len(t) for _, t in turns)
            if size > 1_000_000:
                yield flush(tok, group)
                group, size = [], 0
        if group:
            yield flush(tok, group)

    return run


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of what the formatted texts, offsets and masks hold."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            formatted = batch["formatted"][i].as_py()
            starts, ends, mask = (batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("starts", "ends", "mask"))
            turns = "".join(f"{r}\n{t}\n" for r, t in parse(formatted))
            loss = masked_text(formatted, starts, ends, mask.astype(bool))
            out.append((hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted), len(mask), int(mask.sum())))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["n_turns"], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [x.split()[0] for x in READ.split(", ")])


def format_conversations(df: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a conversation: formatted text, token ids with offsets, loss mask."""
    rows = df.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(formatter(Path(tokenizer).read_text()), FORMATTED)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = format_conversations(said.unionByName(planted)).mapInArrow(read_back, READ)
    return back.drop("n_tokens", "n_loss_tokens")
