"""Token ids in binary files: one concatenated id array, document boundaries in Elias-Fano form.

A shard is one row (`part`, `seq`, `n_docs`, `n_ids`, `doc_ids`, `blob`) of a Parquet table, so Spark
writes, moves and recovers the files on any shared store. `blob` is a file of its own:

    8 bytes magic, then little-endian u64: id width in bytes, number of ids, number of documents,
    low bits l, bytes of low part, bytes of high part, number of select samples; then the low part
    (l bits a boundary), the high part (unary), the samples (u32), the ids.

Boundaries are where documents start, and the total at the end. Each takes 2 + log2(ids / documents)
bits and no 64-bit table is kept: `select` finds one by a sampled jump and a short scan.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeskein.llm._tables import Scratch, in_ranges, partitions
from codeskein.llm._words import SPACE, buffers, column, pieces, span_hashes, word_spans

MAGIC = b"EFTOKEN1"
SAMPLE = 256
SHARD_IDS = 1 << 20
END_ID = 2
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)

SHARD = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("blob", T.BinaryType()),
    ]
)


class Boundaries:
    """A non-decreasing list of integers in Elias-Fano form with a sampled select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> Boundaries:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        at = (values >> low_bits) + np.arange(n)
        unary = np.zeros((int(at[-1]) if n else 0) + 1, np.uint8)
        unary[at] = 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel()), np.packbits(unary), at[::SAMPLE].astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= ((self.low[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(np.int64) << b
        return out

    def select(self, i: int) -> int:
        """The i-th value: jump to the sample before it, count ones byte by byte, then bit by bit."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        first = int(self.high[byte]) & (0xFF >> (at & 7))
        while _ONES[first] <= left:
            left -= int(_ONES[first])
            byte += 1
            first = int(self.high[byte])
        place = byte * 8 + int(np.flatnonzero(np.unpackbits(np.array([first], np.uint8)))[left])
        return ((place - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def decode(self) -> np.ndarray:
        """All values at once."""
        at = np.flatnonzero(np.unpackbits(self.high))[: self.n]
        i = np.arange(self.n)
        return ((at - i) << self.low_bits) | self._low(i)


def pack(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One file of the ids of documents of the given lengths."""
    ef = Boundaries.build(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    head = np.array([width, len(ids), len(lengths), ef.low_bits, len(ef.low), len(ef.high), len(ef.samples)], "<u8")
    parts = [MAGIC, head.tobytes(), ef.low.tobytes(), ef.high.tobytes(), ef.samples.astype("<u4").tobytes()]
    return b"".join([*parts, ids.astype(f"<u{width}").tobytes()])


def unpack(blob: bytes) -> tuple[np.ndarray, Boundaries]:
    """The ids of a file and its boundaries."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token file")
    width, n_ids, n_docs, low_bits, low, high, samples = map(int, np.frombuffer(blob, "<u8", 7, 8))
    at = 64
    a = np.frombuffer(blob, np.uint8, low, at)
    b = np.frombuffer(blob, np.uint8, high, at + low)
    c = np.frombuffer(blob, "<u4", samples, at + low + high)
    ids = np.frombuffer(blob, f"<u{width}", n_ids, at + low + high + 4 * samples)
    return ids, Boundaries(n_docs + 1, low_bits, a, b, c)


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs of all texts in order, and offsets by text.

    A run is a word with the one space before it, or white space that joins no word: of a gap before a
    word all but the last byte, and the last byte if it is no space; at the end of a text the whole gap.
    """
    starts, ends, words = word_spans(data, off)
    n = np.diff(words)
    text = np.repeat(np.arange(len(n)), n)
    before = off[text]  # where the gap before each word begins
    inner = np.ones(len(starts), bool)
    inner[words[:-1][n > 0]] = False
    before[inner] = ends[np.flatnonzero(inner) - 1]
    gap = starts - before
    joins = (gap > 0) & (data[np.maximum(starts - 1, 0)] == 32)
    head, last = np.flatnonzero(gap > 1), np.flatnonzero((gap > 0) & ~joins)
    tail_from = np.where(n > 0, ends[np.maximum(words[1:] - 1, 0)] if len(ends) else 0, off[:-1])
    tail = np.flatnonzero(tail_from < off[1:])
    a = np.concatenate([starts - joins, before[head], starts[last] - 1, tail_from[tail]])
    b = np.concatenate([ends, starts[head] - 1, starts[last], off[1:][tail]])
    order = np.argsort(a, kind="stable")
    return a[order], b[order], np.searchsorted(a[order], off)


class Encoder:
    """Ids of texts by the tokenizers library, which is asked once for each distinct run.

    Byte-level BPE cuts a text where white space meets a word as `runs` does, so a text's ids are those of its
    runs in order. New runs with a space in front go to the library side by side: a token that begins with the
    space's sign begins a run. Texts with other white space than space and 0x09 to 0x0D, and texts that hold the content of
an added token such as <|endoftext|>, go to it whole, and such content has the added token's id. The table of runs
    is keyed by 64-bit hashes and starts anew with the runs at hand when it would pass `keep`.
    """

    OTHERSPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

    def __init__(self, path: str, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = sorted(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.keep = keep
        self.opens = np.array([(self.tok.id_to_token(i) or "").startswith("\u0120") for i in range(self.tok.get_vocab_size())])
        self.hashes, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct runs, concatenated, and their numbers."""
        spaced = (data[a] == 32) & (b - a > 1) & ~SPACE[data[np.minimum(a + 1, len(data) - 1)]]
        n = np.zeros(len(a), np.int64)
        own = np.flatnonzero(spaced)
        raw = data.tobytes()
        parts = []
        self.tok.encode_special_tokens = True  # no text of these runs holds such a token, two runs side by side might
        if len(own):
            cuts = np.flatnonzero(np.diff(np.cumsum(b[own] - a[own]) >> 16)) + 1
            blocks = [b"".join([raw[x:y] for x, y in zip(a[i].tolist(), b[i].tolist())]).decode() for i in np.split(own, cuts)]
            parts = self._library(blocks)
            ids = np.concatenate(parts)
            first = np.flatnonzero(self.opens[ids])
            if len(first) != len(own):
                raise ValueError("this vocabulary does not mark the space in front of a word")
            n[own] = np.diff(np.append(first, len(ids)))
        rest = np.flatnonzero(~spaced)
        others = self._library([raw[a[i] : b[i]].decode() for i in rest])
        self.tok.encode_special_tokens = False
        n[rest] = [len(x) for x in others]
        order = np.concatenate([own, rest])
        ids = np.concatenate([*parts, *others, np.zeros(0, np.uint32)])
        at = np.zeros(len(a), np.int64)
        at[order] = np.cumsum(n[order]) - n[order]
        return _take(ids, at, n), n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and offsets by text."""
        whole = np.array(pc.match_substring_regex(texts, self.OTHERSPACE), bool)
        for content in self.added:
            whole |= np.array(pc.match_substring(texts, content), bool)
        plain = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        data, off = buffers(plain)
        a, b, at = runs(data, off)
        keys, first, back = np.unique(span_hashes(data, a, b), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, keys)
        place[place == len(self.hashes)] = 0
        new = np.flatnonzero(self.hashes[place] != keys) if len(self.hashes) else np.arange(len(keys))
        if len(self.hashes) + len(new) > self.keep:
            new = np.arange(len(keys))
            self.hashes, self.at, self.n, self.ids = self.hashes[:0], self.at[:0], self.n[:0], self.ids[:0]
        ids, n = self._new(data, a[first[new]], b[first[new]])
        put = np.searchsorted(self.hashes, keys[new])
        self.at = np.insert(self.at, put, len(self.ids) + np.cumsum(n) - n)
        self.n = np.insert(self.n, put, n)
        self.hashes = np.insert(self.hashes, put, keys[new])
        self.ids = np.concatenate([self.ids, ids])
        place = np.searchsorted(self.hashes, keys)[back]
        out = _take(self.ids, self.at[place], self.n[place])
        edge = np.concatenate([[0], np.cumsum(self.n[place])])[at]
        if whole.any():
            each = [out[x:y] for x, y in zip(edge[:-1], edge[1:])]
            for i in np.flatnonzero(whole):
                each[i] = self._library([texts[int(i)].as_py()])[0]
            out, edge = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return out, edge


def _take(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[start : start + n] of all places, concatenated."""
    return values[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process, kept from task to task."""
    return Encoder(path)


def encode_texts(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (range_no, doc_id, text) to shard rows, one range after the other."""
    coder, part, seq = encoder(path), None, 0
    names, parts, lengths, held = [], [], [], 0
    end = np.array([end_id], np.uint32)

    def shard() -> pa.RecordBatch:
        ids = np.concatenate(parts)
        row = {"part": part, "seq": seq, "n_docs": len(names), "n_ids": len(ids), "doc_ids": list(names), "blob": pack(ids, np.array(lengths, np.int64))}
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], names=list(row))

    for batch in pieces(batches):
        ranges = batch.column(batch.schema.get_field_index("range_no")).to_pylist()
        doc_ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        ids, edge = coder.encode(column(batch, "text"))
        for at, doc_id, x, y in zip(ranges, doc_ids, edge[:-1], edge[1:]):
            if names and (at != part or held >= shard_ids):
                yield shard()
                seq = seq + 1 if at == part else 0
                names, parts, lengths, held = [], [], [], 0
            part = at
            names.append(doc_id)
            parts += [ids[x:y], end]
            lengths.append(int(y - x) + 1)
            held += lengths[-1]
    if names:
        yield shard()


def write_token_files(
    docs: DataFrame, folder: Scratch, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Encode all texts in ascending doc_id and write shards; returns the table of shards as written.

    Equal doc_ids go by text, a null doc_id comes first, a null text is empty and yields `end_id` alone.
    Only `doc_id` and `text` are looked at. One shuffle deals the texts by range of doc_id; a shard ends
    with the document that brings it to `shard_ids` ids, so a task holds one shard and one text.
    """
    n = partitions(docs.sparkSession)
    dealt = in_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", n)
    ordered = dealt.repartitionById(n, F.col("range_no")).sortWithinPartitions("range_no", "doc_id", "text")
    shards = ordered.mapInArrow(lambda it: encode_texts(it, tokenizer, end_id, shard_ids), SHARD)
    return folder.keep(shards, "token_files", compression="zstd")


def read_token_files(shards: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32.

    Starts need the totals of earlier shards: summed within a part first, then over the parts, of which
    there are as many as the writing job had partitions.
    """
    sizes = shards.select("part", "seq", "n_ids")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    places = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(parts, "part")
    places = places.select("part", "seq", (F.col("ahead") + F.col("inside")).alias("base"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, names, blob in zip(*(batch.column(i) for i in range(4))):
                ids, ef = unpack(blob.as_py())
                edge = ef.decode()
                wide = ids.astype("<u4")
                sums = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:])]
                n = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * n, pa.int32()),
                        pa.array([seq.as_py()] * n, pa.int32()),
                        names.values,
                        pa.array(edge[:-1]),
                        pa.array(np.diff(edge)),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    out = "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long"
    read = shards.select("part", "seq", "doc_ids", "blob").mapInArrow(rows, out).join(places, ["part", "seq"])
    return read.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the token files of `docs` and read them back; see `write_token_files`."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = Scratch(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id))
