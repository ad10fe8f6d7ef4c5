"""Fingerprints of texts from prefix polynomial hashes.

With H[i] = sum of (s_j + 1) B^j over j < i, modulo a prime, any two spans compare in constant time, and the
longest common extension of two places is found by binary search. A fingerprint keeps H at every g-th place,
g the power of two that leaves at most 64 of them, two hashes of the whole, and H at most 64 cuts that the text itself
places: where the hash of the next WINDOW code points ends in so many zero bits. Two fingerprints are compared on the coarser of
their grids, and by the spans between the cuts that both could have, which are equal wherever they stand.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.llm._tables import id_bounds, partitions, range_of
from codeskein.llm._words import column, mix, pieces

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 747_796_405)
MARKS = 64
WINDOW, LEAST_BITS = 16, 4
_P, _31 = np.uint64(PRIME), np.uint64(31)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime 2^31 - 1, for x below 2^62."""
    x = (x & _P) + (x >> _31)
    x = (x & _P) + (x >> _31)
    return np.where(x >= _P, x - _P, x)


class Powers:
    """Powers of a base modulo the prime, as many as were needed so far."""

    def __init__(self, base: int):
        self.table = np.array([1, base], np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = _fold(self.table[-1:] * self.table[1])
            self.table = np.concatenate([self.table, _fold(self.table * step)])
        return self.table[:n]


_POWERS = tuple(Powers(b % PRIME) for b in BASES)
_BACK = Powers(pow(BASES[0], -1, PRIME))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _running(codes: np.ndarray, place: np.ndarray, longest: int, which: int) -> np.ndarray:
    """Running sums of (code + 1) B^place, with a 0 in front; each term is below 2^31."""
    powers = _POWERS[which].upto(max(1, longest))
    out = np.zeros(len(codes) + 1, np.uint64)
    terms = (codes.astype(np.uint64) + np.uint64(1)) * powers[place]
    np.cumsum((terms & _P) + (terms >> _31), out=out[1:])
    return out


class PrefixHash:
    """Span equality and longest common extensions of one text."""

    def __init__(self, text: str):
        codes = code_points(text)
        self.n = len(codes)
        self.sums = [_running(codes, np.arange(self.n), self.n, k) % _P for k in (0, 1)]

    def span(self, start: int, length: int) -> tuple[int, int]:
        """The hash of a span, moved to a common place so that equal spans have equal hashes."""
        out = []
        for k in (0, 1):
            h = (int(self.sums[k][start + length]) - int(self.sums[k][start])) % PRIME
            out.append(h * pow(BASES[k], -start, PRIME) % PRIME)
        return out[0], out[1]

    def extension(self, start: int, other: PrefixHash, there: int) -> int:
        """How many code points from `start` on equal those of `other` from `there` on."""
        low, high = 0, min(self.n - start, other.n - there)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.span(start, mid) == other.span(there, mid) else (low, mid - 1)
        return low


def _cuts(sums: np.ndarray, off: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Zero bits asked for by text; and the text, the place and the zero bits of each cut, in order."""
    at = np.flatnonzero((place > 0) & (place + WINDOW <= np.repeat(n, n)))
    back = _BACK.upto(int(n.max()) + 1)
    x = mix(_fold(((sums[at + WINDOW] - sums[at]) % _P) * back[place[at]]))
    some = (x & np.uint64((1 << LEAST_BITS) - 1)) == 0
    at, x = at[some], x[some]
    bits = np.where(x == 0, 63, np.log2(np.maximum(x & (~x + np.uint64(1)), np.uint64(1)).astype(float))).astype(np.int64)
    text = np.searchsorted(off, at, "right") - 1
    asked = np.full(len(n), LEAST_BITS)
    while (big := np.bincount(text, minlength=len(n)) > MARKS).any():
        asked[big] += 1
        keep = bits >= asked[text]
        at, bits, text = at[keep], bits[keep], text[keep]
    return asked, text, place[at], bits


def fingerprints(texts: list[str]) -> list[str]:
    """`n:g:whole:marks:bits:cuts`, hexadecimal: code points, grid, two whole hashes, and 8 digits for H at each multiple of g;
    then the zero bits asked for, and 24 digits a cut for its place, H, and its zero bits."""
    if not texts:
        return []
    codes = code_points("".join(texts))
    n = np.array([len(t) for t in texts], np.int64)
    off = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(len(codes)) - np.repeat(off[:-1], n)
    sums = [_running(codes, place, int(n.max()), k) for k in (0, 1)]
    whole = [(s[off[1:]] - s[off[:-1]]) % _P for s in sums]
    grid = np.ones(len(n), np.int64)
    while (big := n > MARKS * grid).any():
        grid[big] *= 2
    many = n // grid
    first = np.cumsum(many) - many
    step = np.arange(many.sum()) - np.repeat(first, many) + 1
    at = np.repeat(off[:-1], many) + step * np.repeat(grid, many)
    marks = ((sums[0][at] - np.repeat(sums[0][off[:-1]], many)) % _P).astype(">u4").tobytes().hex()
    asked, text, cut, bits = _cuts(sums[0], off, place, n)
    there = (sums[0][off[text] + cut] - sums[0][off[text]]) % _P
    cuts = np.column_stack([cut, there.astype(np.int64), bits]).astype(">u4").tobytes().hex()
    edge = 24 * np.searchsorted(text, np.arange(len(n) + 1))
    heads = zip(n.tolist(), grid.tolist(), whole[0].tolist(), whole[1].tolist(), first.tolist(), many.tolist(), asked.tolist(), edge[:-1].tolist(), edge[1:].tolist())
    return [f"{a:x}:{g:x}:{h:08x}{k:08x}:{marks[8 * f : 8 * (f + m)]}:{z:x}:{cuts[b:e]}" for a, g, h, k, f, m, z, b, e in heads]


def _spans(n: int, whole: str, asked: int, cuts: str) -> Counter:
    """How often the text has each span between its cuts with the bits asked for, as (length, hash moved to place 0)."""
    rows = np.frombuffer(bytes.fromhex(cuts), ">u4").reshape(-1, 3).astype(np.uint64)
    rows = rows[rows[:, 2] >= asked]
    edges = np.concatenate([[0], rows[:, 0].astype(np.int64), [n]])
    at = np.concatenate([[np.uint64(0)], rows[:, 1], [np.uint64(int(whole[:8], 16))]])
    hashes = _fold(((at[1:] + _P - at[:-1]) % _P) * _BACK.upto(n + 1)[edges[:-1]])
    return Counter(zip(np.diff(edges).tolist(), hashes.tolist()))


def likeness(one: str, two: str) -> float:
    """Share of the longer text that lies in equal spans, as far as the prints tell; 1 if the texts are equal.

    Spans are those of the grid, equal at the same place, or those between cuts, equal anywhere: whichever cover more.
    """
    if one == two:
        return 1.0
    sides, placed = [], []
    for print_ in (one, two):
        n, grid, whole, marks, asked, cuts = print_.split(":")
        placed.append((int(n, 16), whole, int(asked, 16), cuts))
        sides.append((int(n, 16), int(grid, 16), np.frombuffer(bytes.fromhex(marks), ">u4").astype(np.int64)))
    (n, g, a), (m, h, b) = sides
    if not n or not m:
        return 0.0
    step = max(g, h)
    a, b = a[step // g - 1 :: step // g], b[step // h - 1 :: step // h]
    both = min(len(a), len(b))
    low, high = 0, both
    while low < high:  # prefixes are equal up to a mark and then never again, but for collisions
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[mid - 1] == b[mid - 1] else (low, mid - 1)
    spans = (np.diff(a[low:both]) - np.diff(b[low:both])) % PRIME == 0
    asked = max(placed[0][2], placed[1][2])
    ours, theirs = (_spans(size, whole, asked, cuts) for size, whole, _, cuts in placed)
    anywhere = sum(length * times for (length, _), times in (ours & theirs).items())
    return min(1.0, max((low + int(spans.sum())) * step, anywhere) / max(n, m))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the next."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def with_next(docs: DataFrame) -> DataFrame:
    """(range_no, ahead, doc_id, text) in partitions by ascending doc_id, each followed by its successor's first row.

    Ranges come from the ids alone; the first rows of the ranges, one or a few each, are sent to the range before
    as well, marked by `ahead`. The last range gets the first of all.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    place = range_of(F.col("doc_id"), id_bounds(rows, "doc_id", n))
    heads = rows.groupBy(place.alias("range_no")).agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    heads = sorted((r["range_no"], None if r["nulls"] else r["first"]) for r in heads.collect())
    dealt = rows.select(place.alias("range_no"), F.lit(0).alias("ahead"), "doc_id", "text")
    if heads:
        before = {first: heads[i - 1][0] for i, (_, first) in enumerate(heads)}
        ids = [x for x in before if x is not None]
        is_head = F.col("doc_id").isin(ids) if ids else F.lit(False)
        to = F.lit(None).cast("int")
        if ids:
            to = F.create_map(*[F.lit(x) for i in ids for x in (i, before[i])])[F.col("doc_id")]
        if None in before:
            is_head = is_head | F.col("doc_id").isNull()
            to = F.when(F.col("doc_id").isNull(), before[None]).otherwise(to)
        extra = rows.where(is_head).select(to.cast("int").alias("range_no"), F.lit(1).alias("ahead"), "doc_id", "text")
        dealt = dealt.unionByName(extra)
    return dealt.repartitionById(n, F.col("range_no")).sortWithinPartitions("range_no", "ahead", "doc_id", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    waiting = None  # the last document seen: id, text, fingerprint
    for batch in pieces(batches, limit=1 << 20):
        ahead, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        texts = column(batch, "text").to_pylist()
        prints = fingerprints(texts)
        done = []
        for late, doc_id, text, print_ in zip(ahead, ids, texts, prints):
            if waiting is not None:
                done.append((*waiting, edited(waiting[1], text), print_))
            waiting = None if late else (doc_id, text, print_)
        if not done:
            continue
        changed = fingerprints([d[3] for d in done])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([d[0] for d in done], pa.int64()),
                pa.array([len(d[1]) for d in done], pa.int64()),
                pa.array([hashlib.sha256(d[3].encode()).hexdigest() for d in done]),
                pa.array([d[2] for d in done]),
                pa.array(changed),
                pa.array([likeness(d[2], c) for d, c in zip(done, changed)]),
                pa.array([likeness(d[2], d[4]) for d in done]),
            ],
            names=names,
        )


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next by doc_id, then text; a null doc_id comes first and the first follows the last. A
    null text is empty. Repeated rows are documents of their own; other columns are not looked at. One shuffle of the texts.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(_rows, schema)
