"""Conversations as training texts, put together column by column in one Arrow buffer.

A turn becomes `<|turn|>ROLE<|text|>TEXT<|end|>`. Control strings inside roles and texts get a backslash after
their first character (one more, if they have some), which `unescape` takes off again; so `<|` occurs in
the markup only, and control strings of other common templates lose their force too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What follows `<` or `[` in a control string: marks of this template, `s`, `/s`, `INST`, `SYS` of others.
_REST = r"(\||/?s>|/?INST\]|</?SYS>>)"
_ESCAPE = r"([<\[])(\\*)" + _REST
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _REST)
PART_TURNS = 1024
LOSS_ROLE = "assistant"
SCHEMA = "conv_id long, part long, n_turns long, formatted string, loss array<struct<start: long, end: long>>"


def escape(texts: pa.Array) -> pa.Array:
    """Texts without live control strings; nulls become empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return pc.replace_substring_regex(texts, _ESCAPE, r"\1\\\2\3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, off


def assemble(roles: pa.Array, texts: pa.Array, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted text of each run of turns, and first and last code point of each turn's text in it.

    `groups` holds the n + 1 turn offsets of the runs. Segment lengths, their running sum and one index array say
    where each output byte comes from; a single gather fills the buffer.
    """
    fixed = np.frombuffer((TURN + TEXT + END).encode(), np.uint8)
    (role_bytes, role_off), (text_bytes, text_off) = _bytes(roles), _bytes(texts)
    pool = np.concatenate([fixed, role_bytes, text_bytes])
    n = len(texts)
    start, size = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    start[:, 0], size[:, 0] = 0, len(TURN)
    start[:, 1], size[:, 1] = len(fixed) + role_off[:-1], np.diff(role_off)
    start[:, 2], size[:, 2] = len(TURN), len(TEXT)
    start[:, 3], size[:, 3] = len(fixed) + len(role_bytes) + text_off[:-1], np.diff(text_off)
    start[:, 4], size[:, 4] = len(TURN) + len(TEXT), len(END)
    ends = np.cumsum(size.ravel())
    total = int(ends[-1]) if n else 0
    source = np.repeat(start.ravel() - ends + size.ravel(), size.ravel()) + np.arange(total)
    buffer = np.empty(total, np.uint8)
    np.take(pool, source, out=buffer)
    turn_end = np.concatenate([[0], ends[4::5]])
    formatted = pa.LargeStringArray.from_buffers(len(groups) - 1, pa.py_buffer(turn_end[groups]), pa.py_buffer(buffer))
    role_chars, text_chars = (pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (roles, texts))
    chars = np.concatenate([[0], np.cumsum(role_chars + text_chars + len(TURN) + len(TEXT) + len(END))])
    first = chars[:-1] + len(TURN) + role_chars + len(TEXT) - np.repeat(chars[groups[:-1]], np.diff(groups))
    return formatted, first, first + text_chars


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that no run of equal (conv_id, part) is divided."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        cut = len(keys)
        while cut and keys[cut - 1] == keys[-1]:
            cut -= 1
        if keys[0] != last and held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _runs(batches):
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        groups = np.array([0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)])
        role, text = batch.column(2), batch.column(3)
        formatted, first, last = assemble(escape(role), escape(text), groups)
        loss = np.array(pc.fill_null(pc.equal(role, LOSS_ROLE), False), bool)
        at = np.concatenate([[0], np.cumsum(loss)])[groups].astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(first[loss]), pa.array(last[loss])], names=["start", "end"])
        own = pa.array(groups[:-1])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(own),
                batch.column(1).take(own),
                pa.array(np.diff(groups)),
                formatted.cast(pa.string()),
                pa.ListArray.from_arrays(pa.array(at), spans),
            ],
            names=["conv_id", "part", "n_turns", "formatted", "loss"],
        )


def format_chats(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, part, n_turns, formatted, loss): the texts of all conversations, in parts of PART_TURNS turn numbers.

    The text of a conversation is that of its parts in order; nearly all have one. Parts are grouped and sorted on
    their own, so a conversation of any length is never in one task's memory. `loss` has the code point spans, in the
    part's text, of what assistants say. Equal turn numbers go by role, then text; null conv_ids are one
    conversation, a null turn comes first, null roles and texts are empty. Other columns are not looked at.
    """
    conv, turn = F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")
    rows = conversations.select(conv, turn, "role", "text")
    rows = rows.withColumn("part", F.floor(F.col("turn") / PART_TURNS))
    dealt = rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")
    return dealt.select("conv_id", "part", "role", "text").mapInArrow(_format, SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted text."""
    out = []
    marks = formatted.split("<|")[1:]
    for turn, text, end in zip(marks[::3], marks[1::3], marks[2::3]):
        if not (turn.startswith(TURN[2:]) and text.startswith(TEXT[2:]) and end == END[2:]):
            raise ValueError("not a formatted conversation")
        out.append((unescape(turn[len(TURN) - 2 :]), unescape(text[len(TEXT) - 2 :])))
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    rows: list[tuple] = []
    state: list | None = None

    def closed() -> tuple:
        return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

    for batch in batches:
        for conv, formatted, loss in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if state is None or state[0] != conv:
                if state is not None:
                    rows.append(closed())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = unescape(formatted[span["start"] : span["end"]])
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(formatted)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            rows = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(closed(), types)], names=names)


def read_chats(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its formatted parts one after the other."""
    parts = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "formatted", "loss")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return parts.mapInArrow(_digests, schema)
