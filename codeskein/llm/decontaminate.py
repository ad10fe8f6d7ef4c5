"""Benchmark items inside documents: SimHash of item-sized windows, Hamming blocks, exact similarity.

A document window of as many words as an item can have weighted-shingle similarity t to it only if at least
2 t / (1 + t) of its shingles are shingles of items of that size; only such windows are fingerprinted.
The 64 bits of a fingerprint are cut into radius + 1 blocks: two fingerprints within the radius agree in one
of them, so equal blocks find all pairs within it. What is found is verified on the whole multisets of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.llm._tables import Scratch
from codeskein.llm._words import M2, column, mix, multisets, pieces, shingles, word_hashes
from codeskein.llm.near_copies import similarity

SIMILAR = 0.8
RADIUS = 16
SHINGLE = 5
#: Shingles of items that one pass over the documents holds, at 12 bytes each; more items take more passes.
PASS_SHINGLES = 1_000_000


def simhash(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit SimHash of word windows, each occurrence with weight one; an even bit is 0."""
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    sums = np.zeros((len(words) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    ones = sums[starts + sizes] - sums[starts]
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """The shingle of every window of `size` < 5 words, as `shingles` gives it for a text of that many words."""
    h = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for j in range(size):
        h = h * M2 + words[j : j + len(h)]
    return mix(h)


def needed(ours: int, theirs: int, similar: float) -> int:
    """The least overlap of two multisets of these sizes whose similarity reaches `similar`."""
    return math.ceil(similar * (ours + theirs) / (1 + similar) - 1e-9)


class ItemIndex:
    """Shingles of items with the sizes of the items they occur in, as sorted arrays."""

    def __init__(self, pairs: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((sizes, pairs))
        self.shingles, self.sizes = pairs[order], sizes[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.shingles >> np.uint64(42)).astype(np.int64)] = True
        self.short = sorted({int(s) for s in self.sizes if s < SHINGLE})

    def hits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `values` of item shingles and the sizes of those items, one row per place and size."""
        at = np.flatnonzero(self.maybe[(values >> np.uint64(42)).astype(np.int64)])
        low = np.searchsorted(self.shingles, values[at], "left")
        n = np.searchsorted(self.shingles, values[at], "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        take = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.sizes[take]


def windows(words: np.ndarray, index: ItemIndex, places: np.ndarray, sizes: np.ndarray, similar: float):
    """(start, number of words, item size) of the windows of one text that can be similar to an item."""
    found = []
    n = len(words)
    for size in np.unique(sizes):
        at = places[sizes == size]
        size = int(size)
        theirs = max(1, size - SHINGLE + 1)
        if n <= size:
            ours = max(1, n - SHINGLE + 1)
            if len(at) >= needed(ours, theirs, similar):
                found.append((np.array([0]), n, size))
            continue
        least = needed(theirs, theirs, similar)
        if len(at) < least:
            continue
        close = at[: len(at) - least + 1][at[least - 1 :] - at[: len(at) - least + 1] < theirs]
        starts = np.unique((close[:, None] - np.arange(theirs)).ravel())
        starts = starts[(starts >= 0) & (starts <= n - size)]
        inside = np.searchsorted(at, starts + theirs) - np.searchsorted(at, starts)
        starts = starts[inside >= least]
        if len(starts):
            found.append((starts, size, size))
    return found


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        words, off = word_hashes(column(batch, "text"))
        size = np.diff(off)
        values, _, soff = multisets(*shingles(words, off, SHINGLE))
        prints = np.zeros(len(size), np.uint64)
        some = np.flatnonzero(size)
        prints[some] = simhash(words, off[some], size[some])
        lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v.view(np.int64))) for v, o in ((words, off), (values, soff))]
        ids = batch.column(batch.schema.get_field_index("item_id"))
        out = pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(prints.view(np.int64)), *lists], names=["item_id", "size", "print", "words", "own"])
        yield out.filter(pa.array(size > 0))


def _verified(similar: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("words", "item_words"):
                arr = batch.column(batch.schema.get_field_index(name))
                flat, off = arr.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(arr.value_lengths().to_numpy())])
                v, c, soff = multisets(*shingles(flat, off, SHINGLE))
                sides.append([(v[a:b], c[a:b]) for a, b in zip(soff[:-1], soff[1:])])
            got = np.array([similarity(a, b) for a, b in zip(*sides)])
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "item_id", "start", "n_words")]
            out = pa.RecordBatch.from_arrays([*keep, pa.array(got, pa.float64())], names=["doc_id", "item_id", "start", "n_words", "similarity"])
            yield out.filter(pa.array(got >= similar))

    return rows


def contaminated(docs: DataFrame, items: DataFrame, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """Per document and item that it holds: doc_id, item_id, start, n_words, similarity of the best window.

    `start` counts words from 0; the earliest of equally good windows is given. Only doc_id and text of `docs`, item_id and
    text of `items` are looked at. Null and empty texts hold and are nothing; items below five words are one
    shingle; a document shorter than an item is one window. Repeated ids give one row. No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    cast = F.col("item_id").cast("long").alias("item_id")
    item_schema = "item_id long, size long, print long, words array<long>, own array<long>"
    known = scratch.keep(items.select(cast, "text").distinct().mapInArrow(_item_rows, item_schema), "items")
    pairs = scratch.keep(known.select(F.explode("own").alias("shingle"), "size").distinct(), "pairs")
    passes = max(1, math.ceil(pairs.count() / PASS_SHINGLES))
    edges = np.linspace(0, 64, radius + 2).astype(int).tolist()

    def blocks(print_: str):
        part = [F.shiftrightunsigned(F.shiftleft(print_, 64 - b), 64 - (b - a)) for a, b in zip(edges[:-1], edges[1:])]
        return F.posexplode(F.array(*part))

    text_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for k in range(passes):
        # items of one size stay together, so that a pass sees all shingles that a window of that size may share
        mine = F.pmod(F.xxhash64("size"), F.lit(passes)) == k
        own = pairs.where(mine).toArrow()
        if not own.num_rows:
            continue
        index = spark.sparkContext.broadcast(ItemIndex(own.column(0).to_numpy().view(np.uint64), own.column(1).to_numpy()))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            look = index.value
            for batch in pieces(batches):
                words, off = word_hashes(column(batch, "text"))
                values, soff = shingles(words, off, SHINGLE)
                at, size = look.hits(values)
                text = np.searchsorted(soff, at, "right") - 1
                place = at - soff[text]
                for n in look.short:
                    g, s = look.hits(grams(words, n))
                    who = np.searchsorted(off, g, "right") - 1
                    ok = (s == n) & (g + n <= off[who + 1])
                    keep = size != n
                    at, size, text, place = at[keep], size[keep], text[keep], place[keep]
                    text, size = np.append(text, who[ok]), np.append(size, s[ok])
                    place, at = np.append(place, (g - off[who])[ok]), np.append(at, g[ok])
                order = np.lexsort((place, text))
                text, place, size = text[order], place[order], size[order]
                out: list[list] = [[], [], [], [], [], []]
                for i in np.unique(text):
                    a, b = np.searchsorted(text, [i, i + 1])
                    own_words = words[off[i] : off[i + 1]]
                    got = windows(own_words, look, place[a:b], size[a:b], similar)
                    if not got:
                        continue
                    for starts, n, of in got:
                        low, high = int(starts[0]), int(starts[-1]) + n
                        marks = simhash(own_words[low:high], starts - low, np.full(len(starts), n))
                        for s, mark in zip(starts.tolist(), marks.view(np.int64).tolist()):
                            for col, v in zip(out, (int(i), s, n, of, mark, own_words[s : s + n].view(np.int64))):
                                col.append(v)
                ids = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(out[0], pa.int64()))
                plain = [pa.array(c, pa.int64()) for c in out[1:5]]
                yield pa.RecordBatch.from_arrays(
                    [ids, *plain, pa.array(out[5], pa.list_(pa.int64()))], names=["doc_id", "start", "n_words", "size", "mark", "words"]
                )

        seen = text_rows.mapInArrow(scan, "doc_id long, start long, n_words long, size long, mark long, words array<long>")
        seen = scratch.keep(seen, f"windows-{k}")  # written, so that no task runs two Python workers
        seen = seen.select("*", blocks("mark").alias("block", "bits"))
        theirs = known.where(mine).select("item_id", "size", "print", F.col("words").alias("item_words"), blocks("print").alias("block", "bits"))
        same = seen.join(theirs, ["size", "block", "bits"])
        differ = F.col("mark").bitwiseXOR(F.col("print"))
        earlier = [
            (F.col("block") > i) & (F.shiftrightunsigned(F.shiftleft(differ, 64 - b), 64 - (b - a)) == 0)
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))
        ]
        twice = earlier[0]
        for e in earlier[1:]:
            twice = twice | e
        near = same.where((F.bit_count(differ) <= radius) & ~twice)
        near = near.select("doc_id", "item_id", "start", "n_words", "words", "item_words")
        best = near.mapInArrow(_verified(similar), "doc_id long, item_id long, start long, n_words long, similarity double")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, start long, n_words long, similarity double")
    top = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("top")
    grouped = found.groupBy("doc_id", "item_id").agg(top)
    return grouped.select("doc_id", "item_id", (-F.col("top.back")).alias("start"), "top.n_words", "top.similarity")
