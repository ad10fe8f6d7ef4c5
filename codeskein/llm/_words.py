"""Words, word hashes and word shingles of whole texts, for many texts at once in numpy.

A word is a run of bytes other than space and 0x09 to 0x0D; a null text is an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed odd multipliers of the 64-bit mixing steps.
M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
PIECE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column as large strings, nulls as empty texts."""
    arr = pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")
    return arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets into them."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if len(off) else data, off - off[0]


def _give_back() -> None:
    """Free memory goes back to the machine at the end of a task: the worker process lives on and may sit idle."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of about `limit` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64)) // limit
        cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)
    _give_back()


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the n + 1 offsets into the words.

    `space` says of each byte value whether it parts words.
    """
    word = np.zeros(len(data) + 1, bool)
    np.logical_not(space[data], out=word[:-1])
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = off[(off > 0) & (off < len(data))]
    first[edges] = word[edges]
    last = word[:-1] & ~word[1:]
    last[edges - 1] |= word[edges - 1]
    starts, ends = np.flatnonzero(first[:-1]), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 8,), "<u8", padded, strides=(1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) + M3)
    at, who = starts, None
    while len(at):
        part = eight[at] & _KEEP[np.minimum(left, 8)]
        if who is None:
            h = mix(h ^ part * M3)
        else:
            h[who] = mix(h[who] ^ part * M3)
        more = np.flatnonzero(left > 8)
        who = more if who is None else who[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the offsets of each text into them."""
    data, off = buffers(texts)
    starts, ends, words = word_spans(data, off)
    return span_hashes(data, starts, ends), words


def shingles(words: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and offsets by text; a text of 1 to k - 1 words is one shingle."""
    n = np.diff(off)
    full = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        full = full * M1 + words[j : j + len(full)]
    out_n = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_off = np.concatenate([[0], np.cumsum(out_n)])
    out = np.empty(out_off[-1], np.uint64)
    where = np.arange(out_off[-1]) + np.repeat(off[:-1] - out_off[:-1], out_n)
    short = np.repeat(n < k, out_n)
    out[~short] = mix(full[where[~short]])
    for i in np.flatnonzero((n > 0) & (n < k)):
        h = np.uint64(n[i])
        for w in words[off[i] : off[i + 1]]:
            h = np.uint64((int(h) * int(M2) + int(w)) & 0xFFFFFFFFFFFFFFFF)
        out[out_off[i]] = mix(np.array([h], np.uint64))[0]
    return out, out_off


def multisets(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each slice in ascending order, their counts, and offsets by slice."""
    values = values.copy()
    for a, b in zip(off[:-1], off[1:]):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[off[:-1][off[:-1] < len(values)]] = True
    at = np.flatnonzero(new)
    return values[at], np.diff(np.append(at, len(values))), np.searchsorted(at, off)
