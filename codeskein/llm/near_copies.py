"""Near copies of texts by BagMinHash: weighted-Jaccard signatures, bands, exact checks, components.

A text is the multiset of its five-word shingles. Its signature holds, for each of `registers` slots,
the earliest point that any shingle's Poisson process puts into that slot. A shingle that occurs w times
owns the strip (0, w] of weights; the strip is cut at 1, 2, 4, ..., each cut has a process of its own at a
rate equal to its width, and a point lands on one unit cell of its cut and counts if that cell is below w.
So two texts agree in a slot with probability sum(min) / sum(max) of their counts, and a weight costs
only the logarithm of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from codeskein.llm._hot import left_join_split
from codeskein.llm._tables import Scratch
from codeskein.llm._words import M2, M3, column, mix, multisets, pieces, shingles, word_hashes

REGISTERS, BAND = 125, 5
SIMILAR = 0.8
STAR_BANDS = 4
BLOCK = 128
#: Links that a task replaces by stars at once; when no more are left, one task ends the search.
CHUNK = 1 << 19
#: Words of 64 bits in the map that spares texts without candidates the shuffle; 8 MB at most.
MAP_WORDS = 1 << 20


def signatures(values: np.ndarray, counts: np.ndarray, off: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """One row of `registers` 64-bit point marks per text; a text without shingles has zeros.

    Points later than a limit T are not drawn. T is such that hardly any slot stays empty; texts with an
    empty slot are drawn again with twice the limit, so the result doesn't depend on T.
    """
    n = len(off) - 1
    total = np.add.reduceat(np.append(counts, 0), off[:-1]) if n else np.zeros(0)
    total = np.where(off[1:] > off[:-1], total, 0)
    out = np.zeros((n, registers), np.uint64)
    todo = np.flatnonzero(total)
    limit = np.zeros(n)
    limit[todo] = registers / total[todo] * (np.log(registers) + 2.5)
    while len(todo):
        size = off[todo + 1] - off[todo]
        take = np.repeat(off[todo] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        row = np.repeat(np.arange(len(todo)), size)
        got, best = _draw(values[take], counts[take], row, limit[todo], len(todo), registers)
        full = np.isfinite(best).all(1)
        out[todo[full]] = got[full]
        todo = todo[~full]
        limit[todo] *= 2
    return out


def _draw(values, counts, row, limit, n, registers):
    """Marks and times of the earliest points up to `limit` of each of n texts."""
    slots, times, marks = [], [], []
    step, width = 0, 1.0
    alive = np.arange(len(values))
    while len(alive):
        seed = mix(values[alive] + np.uint64(step * int(M2) % (1 << 64)))
        who, weight, base = row[alive], counts[alive], 0 if step == 0 else int(width)
        t, i = np.zeros(len(alive)), 0
        while len(seed):
            i += 1
            mark = mix(seed + np.uint64(i * int(M3) % (1 << 64)))
            t = t - np.log(((mark >> np.uint64(11)) + 0.5) * 2.0**-53) / width
            on = np.flatnonzero(t <= limit[who])
            seed, who, weight, t, mark = seed[on], who[on], weight[on], t[on], mark[on]
            more = mix(mark ^ M2)
            slot = who * registers + ((more >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            if step:
                cell = base + ((more & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width).astype(np.int64)
                own = cell < weight
                slots.append(slot[own]), times.append(t[own]), marks.append(mark[own])
            else:
                slots.append(slot), times.append(t), marks.append(mark)
        base = 1 if step == 0 else 2 * base
        width, step = float(base), step + 1
        alive = np.flatnonzero(counts > base)
    slot, time, mark = np.concatenate(slots), np.concatenate(times), np.concatenate(marks)
    best = np.full(n * registers, np.inf)
    np.minimum.at(best, slot, time)
    got = np.zeros(n * registers, np.uint64)
    first = time == best[slot]
    got[slot[first]] = mark[first]
    return got.reshape(n, registers), best.reshape(n, registers)


def band_keys(marks: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit key per band of `band` slots; the band's number is part of it."""
    n, registers = marks.shape
    cut = marks.reshape(n, registers // band, band)
    h = np.broadcast_to(np.arange(registers // band, dtype=np.uint64) * M3, cut.shape[:2])
    for j in range(band):
        h = mix(h ^ cut[:, :, j] * M3)
    return h.view(np.int64)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        values, counts, off = multisets(*shingles(*word_hashes(column(batch, "text"))))
        keys = band_keys(signatures(values, counts, off))
        some = off[1:] > off[:-1]
        sizes = np.add.reduceat(np.append(counts, 0), off[:-1]) * some
        ends = np.concatenate([[0], np.cumsum(some * keys.shape[1])]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel()))
        keep = [batch.column(batch.schema.get_field_index(c)) for c in ("node", "doc_id")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(sizes.astype(np.int64)), bands], names=["node", "doc_id", "size", "bands"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum(min) / sum(max) of two multisets given as distinct values and counts."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    return low / max(1, int(a[1].sum() + b[1].sum()) - low)


def _check_rows(similar: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text_b"):
            left, right = column(batch, "text_a").dictionary_encode(), column(batch, "text_b").dictionary_encode()
            bags = []
            for side in (left, right):
                v, c, off = multisets(*shingles(*word_hashes(side.dictionary.cast(pa.large_string()))))
                bags.append([(v[x:y], c[x:y]) for x, y in zip(off[:-1], off[1:])])
            at = zip(left.indices.to_pylist(), right.indices.to_pylist())
            ok = pa.array([similarity(bags[0][i], bags[1][j]) >= similar for i, j in at])
            names = [batch.column(batch.schema.get_field_index(c)) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays(names, names=["a", "b"]).filter(ok)

    return rows


def all_similar(values: np.ndarray, counts: np.ndarray, off: np.ndarray, similar: float) -> np.ndarray:
    """Which pairs of n multisets are similar, n x n: overlaps are sums of products of the indicators `count >= level`."""
    n = len(off) - 1
    owner = np.repeat(np.arange(n), np.diff(off))
    _, feature, seen = np.unique(values, return_inverse=True, return_counts=True)
    shared = seen[feature] > 1
    owner, feature, times = owner[shared], feature[shared], counts[shared]
    low, done = np.zeros((n, n)), 0
    for level in np.unique(times):
        on = times >= level
        _, dense = np.unique(feature[on], return_inverse=True)
        order = np.argsort(dense, kind="stable")
        o, f = owner[on][order], dense[order]
        for begin in range(0, int(f[-1]) + 1, 4096):
            x, y = np.searchsorted(f, [begin, begin + 4096])
            part = np.zeros((n, min(4096, int(f[-1]) + 1 - begin)), np.float32)
            part[o[x:y], f[x:y] - begin] = 1.0
            low += (level - done) * (part @ part.T)
        done = level
    size = np.zeros(n)
    np.add.at(size, np.repeat(np.arange(n), np.diff(off)), counts)
    return low / np.maximum(size[:, None] + size - low, 1) >= similar


def _block_rows(similar: float):
    """Rows (task, node, text), sorted by task, to links that connect all similar texts of a task."""

    def links(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes = [n for b in batches for n in b.column(1).to_pylist()]
        bags = [multisets(*shingles(*word_hashes(column(p, "text")))) for p in pieces(iter(batches))]
        sizes = np.concatenate([np.diff(off) for _, _, off in bags])
        off = np.concatenate([[0], np.cumsum(sizes)])
        near = all_similar(np.concatenate([v for v, _, _ in bags]), np.concatenate([c for _, c, _ in bags]), off, similar)
        left = np.ones(len(nodes), bool)
        out: list[tuple] = []
        for root in range(len(nodes)):  # trees that span what is connected
            todo = [root] if left[root] else []
            left[root] = False
            while todo:
                i = todo.pop()
                for j in np.flatnonzero(near[i] & left):
                    left[j] = False
                    out.append((nodes[i], nodes[j]))
                    todo.append(int(j))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            tasks = batch.column(0).to_pylist()
            cuts = [0, *[i for i in range(1, len(tasks)) if tasks[i] != tasks[i - 1]], len(tasks)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if held and tasks[x] != last:
                    yield links(held)
                    held = []
                held.append(batch.slice(x, y - x))
                last = tasks[x]
        if held:
            yield links(held)

    return rows


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the numbers 0 to n - 1 that links (a, b) reach from each."""
    up = np.arange(n)
    while True:
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        apart = low < high
        if not apart.any():
            return up
        a, b = a[apart], b[apart]
        np.minimum.at(up, high[apart], low[apart])
        while (up != up[up]).any():
            up = up[up]


def _star_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) to links from each node to the smallest that it reaches, for CHUNK links at a time: any share of all
    links may be replaced by such stars, and memory has a bound whatever a task gets."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        both = pa.chunked_array([x.column(k).cast(pa.large_binary()) for k in (0, 1) for x in held]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(both.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[both.indices.to_numpy()]
        root = roots(at[: len(at) // 2], at[len(at) // 2 :], len(order))
        on = np.flatnonzero(root != np.arange(len(order)))
        return pa.RecordBatch.from_arrays([both.dictionary.take(pa.array(order[x])).cast(pa.binary()) for x in (on, root[on])], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) > CHUNK:
            yield stars(held)
            held = []
    if sum(x.num_rows for x in held):
        yield stars(held)


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, comp): the smallest node that links (a, b) of binary nodes reach from each; nodes without links are absent.

    Tasks replace the links they hold by stars, before and after each exchange. A round then moves every link from a node
    that isn't smallest to that node's own smallest. Nodes with more than a thousandth of the links, fewer than a
    thousand, are broadcast there, so no task gets all links of a node. One sum by node, combined before its
    shuffle, tells if only stars are left. As soon as at most CHUNK links are left, which is what any task
    may hold, one task ends the search without an exchange.
    """

    def settled(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        seen = Observation()
        done = rows.mapInArrow(_star_rows, "u binary, v binary").observe(seen, F.count("*").alias("n"))
        return scratch.keep(done, name), seen.get["n"]

    edges, n = settled(links.selectExpr("a u", "b v"), f"{label}-0")
    r = 0
    while n:
        if n <= CHUNK:
            edges, n = settled(edges.coalesce(1), f"{label}-last")
            break
        ends = edges.selectExpr("u node", "v low", "1L below", "0L above").unionByName(edges.selectExpr("v node", "null low", "0L below", "1L above"))
        by_node = ends.groupBy("node").agg(F.min("low").alias("low"), F.sum("below").alias("below"), F.sum("above").alias("above"))
        seen = Observation()
        open_ends = by_node.observe(seen, F.count_if(F.expr("below > 1 OR below > 0 AND above > 0")).alias("n"))
        inner = scratch.keep(open_ends.where("below > 0 AND above > 0").select(F.col("node").alias("v"), "low", "above"), f"{label}-inner-{r}")
        if not seen.get["n"]:
            break
        moved = left_join_split(edges, inner, ["v"], "above", n).select("u", F.coalesce("low", "v").alias("v"))
        edges, n = settled(moved.unionByName(inner.selectExpr("v u", "low v")).repartition("u"), f"{label}-{r + 1}")
        scratch.drop(f"{label}-{r}", f"{label}-inner-{r}")
        r += 1
    return edges.selectExpr("u node", "v comp").unionByName(edges.selectExpr("v node", "v comp").distinct())


def _likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be among the wanted ones: by a map of MAP_WORDS words, which has a fixed size and is broadcast.

    A full map lets all rows pass; the exact join that follows is what decides.
    """
    h = F.xxhash64(key)
    word = F.pmod(F.shiftrightunsigned(h, 6), F.lit(MAP_WORDS)).alias("_word")
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64) as int))").alias("_bit")
    bits = wanted.select(word, bit).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.select("*", word).join(F.broadcast(bits), "_word")
    return marked.where(F.getbit("_bits", F.pmod(h, F.lit(64)).cast("int")) == 1).drop("_word", "_bits")


def near_copies(docs: DataFrame, similar: float = SIMILAR, star_bands: int = STAR_BANDS) -> DataFrame:
    """Per row of `docs`: doc_id, class_id, text_id.

    class_id is the smallest doc_id of the texts that links of similarity >= `similar` connect; text_id
    the smallest doc_id with exactly this text.
    Only `doc_id` and `text` are looked at. A null text is an empty one; texts without words are similar to
    equal texts only. Rows may repeat; a null doc_id takes part and names a class only if all its ids are null.

    Candidates are texts that share a band; texts that bands connect form a group. A group of at most BLOCK texts is
    compared in whole by one task. In a larger one each text is first compared with the heads of its buckets in the first
    `star_bands` bands, so that thousands of copies fall together at a few comparisons a copy. What then still shares a
    bucket with another component is compared block against block: no candidate pair between different components stays
    unchecked, and a pair within a component changes nothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-copies")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("node", F.unhex(F.md5("text")))
    marked = base.mapInArrow(_band_rows, "node binary, doc_id long, size long, bands array<long>")
    rows = scratch.keep(marked, "rows")
    texts = scratch.keep(
        rows.groupBy("node").agg(F.min("doc_id").alias("text_id"), F.min("size").alias("size"), F.min("bands").alias("bands")), "texts"
    )
    seats = texts.select("node", "size", F.posexplode("bands").alias("band", "bucket"))
    shared = scratch.keep(seats.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared")
    seats = scratch.keep(_likely(seats, shared, "bucket").join(shared, "bucket"), "seats")

    def grouped(table: DataFrame, name: str) -> DataFrame:
        """(node, grp): nodes that share buckets of `table`, directly or by way of others; buckets are nodes of nine bytes meanwhile."""
        seat = F.concat(F.lit(b"b"), F.unhex(F.lpad(F.hex("bucket"), 16, "0")))
        found = components(table.select(F.col("node").alias("a"), seat.alias("b")), scratch, name)
        return scratch.keep(found.where(F.length("node") == 16).withColumnRenamed("comp", "grp"), f"{name}-members")

    def compared(dealt: DataFrame, name: str) -> DataFrame:
        """Links among the texts of each task."""
        ordered = dealt.repartition("task").sortWithinPartitions("task")
        return scratch.keep(ordered.mapInArrow(_block_rows(similar), "a binary, b binary"), f"links-{name}")

    def in_blocks(members: DataFrame, name: str) -> DataFrame:
        """Links among (grp, node, comp): all pairs of different components of a group, block against block.

        The largest component of a group, if it fills a block, is compared with the rest only.
        """
        sizes = members.groupBy("grp", "comp").agg(F.count("*").alias("n"))
        of = sizes.groupBy("grp").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"))
        rows = members.join(of, "grp").withColumn("core", (F.col("comp") == F.col("main.comp")) & (F.col("main.n") > BLOCK))
        core = F.when(F.col("main.n") > BLOCK, F.col("main.n")).otherwise(0)
        last_p, last_q = (F.greatest(F.ceil(x / BLOCK), F.lit(1)) - 1 for x in (core, F.col("n") - core))
        rows = rows.select("grp", "node", "core", last_p.alias("last_p"), last_q.alias("last_q"), (core > 0).alias("some"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("core"), F.col("last_p")).otherwise(F.col("last_q")) + 1))
        others = F.sequence(F.lit(0), F.when(F.col("core"), F.col("last_q")).otherwise(F.col("last_p"))).cast("array<long>")
        side = F.transform(
            F.when(F.col("some"), others).otherwise(F.array().cast("array<long>")),
            lambda k: F.struct(
                F.lit(0).alias("kind"), F.when(F.col("core"), F.col("own")).otherwise(k).alias("i"), F.when(F.col("core"), k).otherwise(F.col("own")).alias("j")
            ),
        )
        rest = F.transform(
            F.sequence(F.lit(0), F.col("last_q")).cast("array<long>"),
            lambda k: F.struct(F.lit(1).alias("kind"), F.least("own", k).alias("i"), F.greatest("own", k).alias("j")),
        )
        tasks = F.when(F.col("core"), side).otherwise(F.concat(side, rest))
        dealt = rows.join(bodies.select("node", "text"), "node").select("grp", F.explode(tasks).alias("t"), "node", "text")
        return compared(dealt.select(F.concat_ws(":", F.hex("grp"), "t.kind", "t.i", "t.j").alias("task"), "node", "text"), name)

    groups = grouped(seats, "groups")
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    placed = scratch.keep(groups.join(sizes, "grp"), "placed")
    bodies = _likely(base.select("node", "text"), placed, "node").join(placed, "node").dropDuplicates(["node"])
    bodies = scratch.keep(bodies.select("node", "grp", "n", "text"), "bodies")
    links = compared(bodies.where(F.col("n") <= BLOCK).select(F.hex("grp").alias("task"), "node", "text"), "small")
    large = scratch.keep(placed.where(F.col("n") > BLOCK).select("node"), "large")

    if not large.isEmpty():
        crowd = scratch.keep(seats.join(large, "node"), "crowd")
        heads = crowd.where(F.col("band") < star_bands).groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "size")).alias("head"))
        fits = (F.col("size") >= similar * F.col("head.size")) & (F.col("head.size") >= similar * F.col("size"))
        rivals = crowd.join(heads, "bucket").where((F.col("node") != F.col("head.node")) & fits)
        pairs = rivals.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()
        full = pairs.join(bodies.selectExpr("node b", "text text_b"), "b").join(bodies.selectExpr("node a", "text text_a"), "a")
        found = scratch.keep(full.select("a", "b", "text_a", "text_b").mapInArrow(_check_rows(similar), "a binary, b binary"), "star-links")
        stars = components(found, scratch, "stars")
        now = crowd.join(stars, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        split = now.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        rest = scratch.keep(now.join(split.select("bucket"), "bucket"), "rest")
        own = rest.select("node", "comp").distinct().join(grouped(rest, "rest-groups"), "node")
        links = links.unionByName(found).unionByName(in_blocks(own.select("grp", "node", "comp"), "rest"))
    comps = components(links, scratch, "comps")

    class_ids = comps.join(texts.select("node", "text_id"), "node").groupBy("comp").agg(F.min("text_id").alias("class_id"))
    linked = scratch.keep(comps.join(class_ids, "comp").select("node", "class_id"), "linked")
    scratch.drop("shared", "seats", "placed", "bodies", "large", "crowd", "rest")
    whole = texts.select("node", "text_id").join(linked, "node", "left")
    found = rows.select("node", "doc_id").join(whole, "node")
    return found.select("doc_id", F.coalesce("class_id", "text_id").alias("class_id"), "text_id")
