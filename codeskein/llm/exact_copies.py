"""Exact duplicates by a tree merge of sorted digest runs.

Texts are equal when they agree after white space is deleted. Each task sorts what it has read into a run of entries, one for
each distinct text: digest, proof (SHA-256 and byte length of the text), the row that stays so far, and the number of rows.
Runs then meet in binomial rounds. The tasks of a round form groups of `FAN` lanes that differ in one digit of their number;
each sends the lanes of its group the part of its run that belongs there by the same digit of the digest, and merges the parts
it gets. After as many rounds as lane numbers have digits every digest has met all its equals in one lane, with no
task holding more than its share: a text with very many copies is one entry of a run at every level. Entries
become one only if digest and proof agree; digests that agree alone stay apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeskein.llm._hot import left_join_split
from codeskein.llm._tables import Scratch, partitions
from codeskein.llm._words import _give_back

SPACES = " \t\n\x0b\x0c\r"
FAN_BITS = 3
FAN = 1 << FAN_BITS
#: Entries in a stored piece of a run, in a task's run, and held back before a merge step.
PIECE, RUN, PENDING = 2048, 1 << 20, 1 << 16
ENTRY = np.dtype(
    [("digest", "<u8"), ("p0", "<u8"), ("p1", "<u8"), ("p2", "<u8"), ("p3", "<u8"), ("size", "<i8"),
     ("chars", "<i8"), ("no_id", "<i8"), ("id", "<i8"), ("row", "<i8"), ("n", "<i8")]
)
_PROOF = ("digest", "p0", "p1", "p2", "p3", "size")
_SIGN = np.uint64(1 << 63)
PIECES = "lane int, first long, entries binary"


def merged(parts: list[np.ndarray]) -> np.ndarray:
    """The entries of several sorted runs as one sorted run, equal texts as one entry with the row that stays."""
    rows = np.concatenate(parts) if len(parts) > 1 else parts[0]
    if not len(rows):
        return rows
    best_first = (rows["row"], rows["id"], rows["no_id"], -rows["chars"])
    rows = rows[np.lexsort((*best_first, *[rows[c] for c in reversed(_PROOF)]))]
    new = np.ones(len(rows), bool)
    new[1:] = False
    for c in _PROOF:
        new[1:] |= rows[c][1:] != rows[c][:-1]
    at = np.flatnonzero(new)
    out = rows[at]
    out["n"] = np.add.reduceat(rows["n"], at)
    return out


def _digit(digest: np.ndarray, k: int) -> np.ndarray:
    return (digest >> np.uint64(64 - FAN_BITS * (k + 1))) & np.uint64(FAN - 1)


def _pieces(run: np.ndarray, lane: int, k: int, digits: int) -> Iterator[tuple[int, int, bytes]]:
    """A sorted run in pieces, each for the lane that has digit k of its digests in place of its own."""
    shift = FAN_BITS * (digits - 1 - k)
    digit = _digit(run["digest"], k).astype(np.int64)
    cuts = [0, *(np.flatnonzero(digit[1:] != digit[:-1]) + 1).tolist(), len(run)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        for i in range(a, b, PIECE):
            part = run[i : min(b, i + PIECE)]
            to = (lane & ~((FAN - 1) << shift)) | (int(digit[i]) << shift)
            yield to, int((part["digest"][0] ^ _SIGN).astype(np.int64)), part.tobytes()


def _batch(pieces: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    lane, first, entries = zip(*pieces)
    return pa.RecordBatch.from_arrays([pa.array(lane, pa.int32()), pa.array(first, pa.int64()), pa.array(entries, pa.binary())], names=["lane", "first", "entries"])


def _batches(pieces: Iterator[tuple[int, int, bytes]], at_once: int = 32) -> Iterator[pa.RecordBatch]:
    held = []
    for piece in pieces:
        held.append(piece)
        if len(held) == at_once:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _own_runs(digits: int) -> Callable:
    """Runs of the rows of a task, cut into the pieces of the first round."""

    def entries(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, ENTRY)
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        proof = np.frombuffer(b"".join(col["proof"].to_pylist()), ">u8").reshape(-1, 4)
        for i in range(4):
            out[f"p{i}"] = proof[:, i]
        out["digest"] = col["digest"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        out["no_id"] = col["doc_id"].is_null().to_numpy(zero_copy_only=False)
        out["id"] = col["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
        for name, of in (("size", "size"), ("chars", "chars"), ("row", "row_no")):
            out[name] = col[of].to_numpy(zero_copy_only=False)
        out["n"] = 1
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId() % FAN**digits
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(entries(batch))
                n += batch.num_rows
            if n >= RUN:
                held = [merged(held)]
                n = len(held[0])
                if n >= RUN // 2:
                    yield from _batches(_pieces(held[0], lane, 0, digits))
                    held, n = [], 0
        if n:
            yield from _batches(_pieces(merged(held), lane, 0, digits))
        _give_back()

    return work


def _merged_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Of pieces in order of (lane, first digest): each lane's entries, merged, in ascending stretches.

    What lies below the first digest of the piece at hand is complete, so only about a piece of each run is held.
    """
    lane, held, n = None, [], 0
    for batch in batches:
        for at, first, entries in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if at != lane and held:
                yield lane, merged(held)
                held, n = [], 0
            lane = at
            if n >= PENDING:
                rows = merged(held)
                done = np.searchsorted(rows["digest"], np.int64(first).view(np.uint64) ^ _SIGN)
                if done:
                    yield lane, rows[:done]
                held, n = [rows[done:]], 0
            part = np.frombuffer(entries, ENTRY)
            held.append(part)
            n += len(part)
    if held:
        yield lane, merged(held)
    _give_back()


def _round(k: int, digits: int) -> Callable:
    """Merge the pieces that round k - 1 sent, and cut the results for round k."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(piece for lane, run in _merged_runs(batches) for piece in _pieces(run, lane, k, digits))

    return work


GROUPS = "digest long, proof binary, size long, keep_id long, keep_row long, group_size long"


def _last_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, run in _merged_runs(batches):
        for i in range(0, len(run), 16 * PIECE):
            part = run[i : i + 16 * PIECE]
            proof = np.stack([part[f"p{j}"] for j in range(4)], 1).astype(">u8").tobytes()
            columns = [
                pa.array(part["digest"].copy().view(np.int64)),
                pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(part), [None, pa.py_buffer(proof)]).cast(pa.binary()),
                pa.array(part["size"].copy()),
                pa.array(part["id"].copy(), mask=part["no_id"].astype(bool)),
                pa.array(part["row"].copy()),
                pa.array(part["n"].copy()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "proof", "size", "keep_id", "keep_row", "group_size"])


def exact_groups(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(digest, proof, size, keep_id, keep_row, group_size) of each distinct text of `rows`.

    `rows` has doc_id, row_no, digest (long), proof (32 bytes), size and chars; it should read a written table, as a task that is
    run again must find the same rows.
    """
    lanes = partitions(rows.sparkSession)
    digits = max(1, math.ceil(math.log(max(lanes, 2), FAN) - 1e-9))
    pieces = rows.select("doc_id", "row_no", "digest", "proof", "size", "chars").mapInArrow(_own_runs(digits), PIECES)
    for k in range(1, digits + 1):
        met = pieces.repartition(FAN**digits, "lane").sortWithinPartitions("lane", "first")
        pieces = met.mapInArrow(_round(k, digits), PIECES) if k < digits else met.mapInArrow(_last_round, GROUPS)
    return scratch.keep(pieces, "groups")


def exact_copies(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """For each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared without the characters U+0020 and U+0009 to U+000D; null counts as empty, and texts without anything
    else are equal to it. Of equal texts the row with the most code points before that stays, then the smallest doc_id (null
    last), then, of rows that agree in both, one of them; so each group keeps exactly one row. `keep_id` is
    null if the row that stays has no doc_id. No rows give no rows. Columns other than doc_id and text are not read.

    `digest` maps a text to the 64-bit number by which runs are sorted; `proof` tells texts with the same number apart.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.translate(text, SPACES, "")
    rows = docs.select("doc_id", plain.alias("plain"), F.char_length(text).cast("long").alias("chars")).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row_no"),
        digest(F.col("plain")).cast("long").alias("digest"),
        F.unhex(F.sha2("plain", 256)).alias("proof"),
        F.octet_length("plain").cast("long").alias("size"),
        "chars",
    )
    rows = scratch.keep(rows, "digests")
    groups = exact_groups(rows, scratch)
    copied = groups.where("group_size > 1")
    keys = ["digest", "proof", "size"]
    met = left_join_split(rows, copied, keys, "group_size", rows.count())
    alone = F.col("keep_row").isNull()
    return met.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row_no"), F.lit(True)).alias("kept"),
        F.lower(F.hex("proof")).alias("text_sha256"),
    )
