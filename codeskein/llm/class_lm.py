"""Brown class bigrams: words in classes by exchange, class transitions and word emissions give scores.

The counts cover all training texts: one pass counts words, one writes the texts as word numbers, and the rest work on those.
Every word that occurs twice has a class of its own choice; words seen once, and words never seen, are of the class TAIL. The end
of a text is a class of its own and stands before its first word. The classes start from an exchange on the driver over the
CLUSTERED most frequent words; from there on rounds over all words and all their neighbours, on both sides, move them.
The HEAD_WORDS most frequent words have numbers that tasks hold, to spare joins; the others, by hash, are joined with
their classes, and what comes out does not depend on where the line is drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeskein.llm._tables import Scratch
from codeskein.llm._words import buffers, column, mix, pieces, span_hashes, word_spans

HEAD_WORDS = 1_000_000
CLUSTERED = 1200
CLASSES = 32
EXCHANGES = 6
ROUNDS = 3
BUFFERED = 1 << 22
PULL = 10.0
END_ID, TAIL_ID = -1, -2  # word numbers of the end of a text and of words without a number


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A to Z in lower case, and offsets by text."""
    data, off = buffers(texts)
    low = data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    starts, ends, words = word_spans(low, off)
    return span_hashes(low, starts, ends), words


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        values, n = np.unique(_hashed(column(batch, "text"))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): how often each word, as a 64-bit hash, occurs in all texts."""
    return texts.select("text").mapInArrow(_count_rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def exchange(pairs: np.ndarray, classes: int, rounds: int = EXCHANGES) -> np.ndarray:
    """A class for each word of a square matrix of pair counts, so that classes tell most about the next class.

    Word after word, from the first on, goes to the class where the sum of N(g, h) ln N(g, h), less that of the class
    totals, becomes largest; rounds end when no word moves.
    """
    n = len(pairs)
    own = np.arange(n) % classes
    if n <= classes:
        return own
    xlogx = lambda x: x * np.log(np.maximum(x, 1.0))
    member = np.zeros((n, classes))
    member[np.arange(n), own] = 1.0
    after, before = pairs @ member, pairs.T @ member  # of each word: counts of next and of previous classes
    table = member.T @ after
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            a, self_pairs = own[w], pairs[w, w]
            out, into = after[w].copy(), before[w].copy()
            out[a] -= self_pairs
            into[a] -= self_pairs
            table[a] -= out
            table[:, a] -= into
            table[a, a] -= self_pairs
            rows, cols = table.sum(1) + into, table.sum(0) + out  # wherever the word goes, its pairs count
            diagonal = np.diag(table)
            gain = (xlogx(table + out) - xlogx(table)).sum(1) + (xlogx(table.T + into) - xlogx(table.T)).sum(1)
            gain -= xlogx(diagonal + out) + xlogx(diagonal + into) - xlogx(diagonal) - xlogx(diagonal + out + into + self_pairs)
            gain -= xlogx(rows + out.sum() + self_pairs) - xlogx(rows) + xlogx(cols + into.sum() + self_pairs) - xlogx(cols)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += out
            table[:, b] += into
            table[b, b] += self_pairs
            if b != a:
                moved += 1
                own[w] = b
                after[:, a] -= pairs[:, w]
                after[:, b] += pairs[:, w]
                before[:, a] -= pairs[w]
                before[:, b] += pairs[w]
        if not moved:
            break
    return own


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of a batch, each text with its end, and offsets by text."""
    arr = batch.column(batch.schema.get_field_index("ids")).cast(pa.large_binary())
    data, off = buffers(arr)
    return np.frombuffer(data.tobytes(), np.int32), off // 4


def _encode(head) -> object:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, order = head.value
        for batch in pieces(batches):
            hashes, off = _hashed(column(batch, "text"))
            values, back = np.unique(hashes, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, values), max(0, len(keys) - 1))
            known = keys[at] == values if len(keys) else np.zeros(len(values), bool)
            number = np.full(len(values), TAIL_ID, np.int32)
            number[known] = order[at[known]]
            ids = number[back]
            n = np.diff(off)
            tail = ids == TAIL_ID
            tail_off = np.concatenate([[0], np.cumsum(tail)])[off]
            tails = pa.LargeListArray.from_arrays(pa.array(tail_off), pa.array(hashes[tail].view(np.int64)))
            full_off = off + np.arange(len(off))
            full = np.full(full_off[-1], END_ID, np.int32)
            full[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(full_off * 4), pa.py_buffer(full.tobytes())])
            spots = np.flatnonzero(full == TAIL_ID)
            sides = [pa.LargeListArray.from_arrays(pa.array(tail_off), pa.array(np.append(full, END_ID)[spots + d])) for d in (-1, 1)]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "training")]
            lists = [tails.cast(pa.list_(pa.int64())), *[x.cast(pa.list_(pa.int32())) for x in sides]]
            yield pa.RecordBatch.from_arrays([*keep, blobs.cast(pa.binary()), *lists], names=["doc_id", "training", "ids", "tail", "before", "after"])

    return rows


def _pairs(clustered: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(clustered * clustered, np.int64)
        for batch in batches:
            ids, _ = _numbers(batch)
            left, right = ids[:-1], ids[1:]
            both = (left >= 0) & (left < clustered) & (right >= 0) & (right < clustered)
            total += np.bincount(left[both].astype(np.int64) * clustered + right[both], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    return rows


def _counted(keys: list[np.ndarray], width: int, named: bool) -> pa.RecordBatch:
    """Rows (tail, word, own, slot, n) of buffered (tail, word, own, slot) columns; without names, words are not told apart."""
    tail, word, own, slot = (np.concatenate(k) for k in zip(*keys))
    packed = own.astype(np.int64) * (2 * width + 1) + slot
    if not named:
        tail, word = np.zeros(len(tail), bool), np.zeros(len(word), np.int64)
    order = np.lexsort((packed, word, tail)) if named else np.argsort(packed, kind="stable")
    tail, word, packed = tail[order], word[order], packed[order]
    new = np.ones(len(order), bool)
    new[1:] = (tail[1:] != tail[:-1]) | (word[1:] != word[:-1]) | (packed[1:] != packed[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(order)))
    cols = [tail[at], word[at], (packed[at] // (2 * width + 1)).astype(np.int32), (packed[at] % (2 * width + 1)).astype(np.int32), n]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["tail", "word", "own", "slot", "n"])


def _events(left, right, width):
    """What two neighbours (tail, word, class) tell: the class after the one, before the other, and whether they are the same word."""
    (lt, lw, lc), (rt, rw, rc) = left, right
    same = (lw == rw) & (lt == rt)
    return [(lt, lw, lc, rc.astype(np.int64)), (rt, rw, rc, width + lc.astype(np.int64)), (lt[same], lw[same], lc[same], np.full(int(same.sum()), 2 * width))]


def _contexts(sent, width: int, named: bool):
    """Counts of neighbours that both have numbers or are ends; slots are classes after, classes before, and the word itself."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, slots = sent.value, 2 * width + 1
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            word, slot = values // slots + TAIL_ID, (values % slots).astype(np.int32)
            cols = [np.zeros(len(word), bool), word if named else np.zeros_like(word), own[word].astype(np.int32), slot, n]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["tail", "word", "own", "slot", "n"])

        for batch in batches:
            ids, _ = _numbers(batch)
            left = np.concatenate([[END_ID], ids[:-1]])
            use = (ids != TAIL_ID) & (left != TAIL_ID)
            left, right = left[use].astype(np.int64), ids[use].astype(np.int64)
            held.append((left - TAIL_ID) * slots + own[right])
            held.append((right - TAIL_ID) * slots + width + own[left])
            held.append((left[left == right] - TAIL_ID) * slots + 2 * width)
            if sum(map(len, held)) > BUFFERED:
                yield out()
        if held:
            yield out()

    return rows


def _beside(batch: pa.RecordBatch, own: np.ndarray, tail_class: int):
    """Words without numbers in their order: row of the batch, (tail, word, class), count; and their neighbours' ids.

    Words seen twice are themselves, all others are the word TAIL_ID of the class TAIL.
    """
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    size = get("before").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(size) - size
    before, after = get("before").flatten().to_numpy(), get("after").flatten().to_numpy()
    tail, word = np.zeros(len(before), bool), np.full(len(before), TAIL_ID, np.int64)
    kind, n = np.full(len(before), tail_class, np.int64), np.zeros(len(before), np.int64)
    seen = get("seen")
    at = np.repeat(first, np.nan_to_num(seen.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    flat = seen.flatten()
    at = at + flat.field(0).to_numpy()
    n[at] = flat.field(2).to_numpy()
    kind[at] = flat.field(3).to_numpy()
    many = at[n[at] > 1]
    tail[many] = True
    word[at] = np.where(n[at] > 1, flat.field(1).to_numpy(), TAIL_ID)
    return np.repeat(np.arange(len(size)), size), (tail, word, kind), n, before, after


def _neighbours(batch: pa.RecordBatch, own: np.ndarray, tail_class: int):
    """Pairs of neighbours of which one at least has no number: rows, left and right (tail, word, class), right counts (-1: numbered)."""
    row, words, n, before, after = _beside(batch, own, tail_class)
    number = lambda ids: (np.zeros(len(ids), bool), ids.astype(np.int64), own[ids].astype(np.int64))
    left = number(before)
    lone = before == TAIL_ID  # then the word before is the one before in the list
    left = tuple(np.where(lone, np.concatenate([w[:1], w[:-1]]), x) for w, x in zip(words, left))
    last = after != TAIL_ID
    right = number(after[last])
    pairs = [np.concatenate(x) for x in ([row, row[last]], [n, np.full(int(last.sum()), -1)])]
    return pairs[0], tuple(np.concatenate([a, b[last]]) for a, b in zip(left, words)), tuple(np.concatenate([a, b]) for a, b in zip(words, right)), pairs[1]


def _tail_contexts(sent, width: int, named: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            _, left, right, _ = _neighbours(batch, sent.value, width - 2)
            held += _events(left, right, width)
            if sum(len(h[0]) for h in held) > BUFFERED // 4:
                yield _counted(held, width, named)
                held = []
        if held:
            yield _counted(held, width, named)

    return rows


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def told(table: np.ndarray) -> float:
    """What the exchange makes large: the sum of N(g, h) ln N(g, h), less that of the class totals."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def best_classes(table: np.ndarray, own: np.ndarray, out: np.ndarray, into: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The class where each word, alone, would make `told` largest; the last two classes (TAIL, end) are not chosen.

    `out` and `into` count the classes after and before each word, `same` the word after itself. A word without a class of
    choice leaves TAIL in any case. Only counts above zero are looked at.
    """
    k, width = out.shape
    classes, every = width - 2, np.arange(k)
    out, into = out.copy(), into.copy()
    out[every, own] -= same
    into[every, own] -= same
    gain = np.zeros((k, classes))
    for side, other, t in ((out, into, table), (into, out, table.T)):
        w, h = np.nonzero(side)
        n = side[w, h][:, None]
        base = t[:classes, :][:, h].T.copy()
        inner = own[w] < classes
        base[np.flatnonzero(inner), own[w[inner]]] -= n[inner, 0]
        away = np.flatnonzero(h == own[w])
        base[away] -= other[w[away], :classes]
        away = away[inner[away]]
        base[away, own[w[away]]] -= same[w[away]]
        gain += _summed(w, _xlogx(base + n) - _xlogx(base), k)
    o, i, total = out[:, :classes], into[:, :classes], np.diag(table)[:classes]
    inner = np.flatnonzero(own < classes)
    diagonal = np.repeat(total[None], k, axis=0)
    diagonal[inner, own[inner]] -= out[inner, own[inner]] + into[inner, own[inner]] + same[inner]
    gain -= _xlogx(diagonal + o) + _xlogx(diagonal + i) - _xlogx(diagonal) - _xlogx(diagonal + o + i + same[:, None])
    for sums, own_sum in ((table.sum(1), out.sum(1)), (table.sum(0), into.sum(1))):
        line = np.repeat(sums[None, :classes], k, axis=0)
        line[inner, own[inner]] -= own_sum[inner] + same[inner]
        gain -= _xlogx(line + (own_sum + same)[:, None]) - _xlogx(line)
    best = gain.argmax(1)
    stay = own[inner]
    best[inner] = np.where(gain[inner, best[inner]] <= gain[inner, stay] + 1e-9, stay, best[inner])
    return best


def _summed(w: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Sums of rows by ascending w."""
    out = np.zeros((k, values.shape[1]))
    at = np.flatnonzero(np.diff(w, prepend=-1))
    if len(at):
        out[w[at]] = np.add.reduceat(values, at, axis=0)
    return out


def _chosen(sent, turn: int):
    """Words with their contexts, to their classes; of words that have a class, a half by hash may move in a turn."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hashes = sent.value
        width = len(table)
        for whole in batches:
            for begin in range(0, whole.num_rows, 4096):
                batch = whole.slice(begin, 4096)
                own, seen = batch.column(2).to_numpy().astype(np.int64), batch.column(3)
                who = np.repeat(np.arange(len(own)), seen.value_lengths().to_numpy(zero_copy_only=False))
                flat = seen.flatten()
                dense = np.zeros((len(own), 2 * width + 1))
                dense[who, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
                best = best_classes(table, own, dense[:, :width], dense[:, width:-1], dense[:, -1])
                word = batch.column(1).to_numpy().view(np.uint64).copy()
                head = np.flatnonzero(~batch.column(0).to_numpy(zero_copy_only=False))
                word[head] = hashes[word[head].astype(np.int64)]
                turns = (mix(word) >> np.uint64(7)) % np.uint64(2) == turn % 2
                best = np.where(turns | (own >= width - 2), best, own)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32))], names=["tail", "word", "class"])

    return rows


class ClassModel:
    """Counts of words by number, their classes, log10 transitions, class totals, and the sizes that smoothing needs."""

    def __init__(self, counts, classes, steps, totals, tokens, distinct, once):
        self.counts, self.classes, self.steps, self.totals = counts, classes, steps, totals
        self.tokens, self.distinct, self.once = tokens, distinct, once


def _scores(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        emit = np.log10(np.maximum(m.counts, 1) / np.maximum(m.totals[m.classes], 1))
        emit[-1] = 0.0  # the end of a text, number -1
        plain = np.log10(m.counts + 1.0) - np.log10(m.tokens + m.distinct + 1)
        plain[-2] = -np.log10(m.tokens + m.distinct + 1)  # and log10(c + 1), which is joined
        known = m.counts > 0
        known[-2] = False
        for batch in batches:
            ids, off = _numbers(batch)
            left = np.concatenate([[END_ID], ids[:-1]])
            each = m.steps[m.classes[left], m.classes[ids]] + emit[ids]
            each[(ids == TAIL_ID) | (left == TAIL_ID)] = 0.0  # these are joined
            cols = [np.add.reduceat(x, off[:-1]) if len(ids) else np.zeros(0) for x in (each, plain[ids], known[ids].astype(np.int64))]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc_id", "training")]
            cols = [pa.array(c) for c in cols]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(np.diff(off)), cols[2], cols[1], cols[0]],
                names=["row", "doc_id", "training", "n_tokens", "n_known", "base_score", "score"],
            )

    return rows


def _tail_scores(model):
    """What words without numbers add to a row: known tokens, log10(c + 1), and transitions and emissions of all pairs that touch one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        tail_class = len(m.totals) - 2
        emit = np.log10(np.maximum(m.counts, 1) / np.maximum(m.totals[m.classes], 1))
        emit[-1] = 0.0
        for batch in batches:
            row, _, n, _, _ = _beside(batch, m.classes, tail_class)
            known, more = np.bincount(row, n > 0, batch.num_rows), np.bincount(row, np.log10(n + 1.0), batch.num_rows)
            row, left, right, n = _neighbours(batch, m.classes, tail_class)
            one = np.log10(np.maximum(n, 1) / np.maximum(m.totals[right[2]], 1))
            one = np.where(n > 1, one, np.log10(np.maximum(n, 0) + 1.0) - np.log10(2 * m.once + 1))
            numbered = n < 0
            one[numbered] = emit[right[1][numbered]]
            score = np.bincount(row, m.steps[left[2], right[2]] + one, batch.num_rows)
            cols = [pa.array(known.astype(np.int64)), pa.array(more), pa.array(score)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["row", "more_known", "more_base", "more_score"])

    return rows


def scored_texts(docs: DataFrame, training: Column, head_words: int = HEAD_WORDS, clustered: int = CLUSTERED, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """Per row of `docs`: doc_id, training, n_tokens, n_known, train_tokens, base_score, score; log10 throughout.

    Rows where `training` (null: false) teach the model, all are scored. Tokens are words and one end per text; a null text
    is an end alone. base_score is the add-one unigram's; score is the sum of log10 P(class | class before) and
    log10 P(word | class). Transitions are drawn towards class shares with a weight of PULL. Rows may repeat; other columns
    are not looked at. Without training rows every token is unknown. The driver holds the counts of `head_words` words, the
    pairs of `clustered` and the tables of classes, all of fixed size; counts and classes of other words are joined. In the first
    of `rounds` rounds all words beyond `clustered` take classes, in each later one half of all words may move; a
    round that makes `told` smaller is undone and ends them.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    scratch = Scratch(spark, "class-lm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"), "text")
    words = scratch.keep(word_counts(rows.where("training")), "words")
    texts = rows.where("training").count()
    all_words, all_tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    # the head is cut where counts change by a 64th of a power of two, so that no task ranks the words
    level = F.floor(F.log2(F.col("n").cast("double")) * 64)
    levels = words.where("n > 1").groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    fitting = np.cumsum([r["words"] for r in levels]) <= head_words
    least = levels[int(fitting.sum()) - 1]["level"] if fitting.any() else None
    top = words.where(F.lit(False) if least is None else (F.col("n") > 1) & (level >= least)).toArrow()
    top = top.sort_by([("n", "descending"), ("word", "ascending")])
    hashes = top.column(0).to_numpy().view(np.uint64)
    # numbers in order of frequency; the last two places are TAIL_ID and END_ID
    counts = np.append(top.column(1).to_numpy(), [0, texts]).astype(np.int64)
    order = np.argsort(hashes)
    head = sc.broadcast((hashes[order], order.astype(np.int32)))
    coded = rows.mapInArrow(_encode(head), "doc_id long, training boolean, ids binary, tail array<long>, before array<int>, after array<int>")
    coded = scratch.keep(coded.withColumn("row", F.monotonically_increasing_id()), "coded", compression="zstd")
    learn = coded.where("training").select("ids")

    width, tail_class, end_class = classes + 2, classes, classes + 1
    clustered = min(clustered, len(hashes))
    own = np.full(len(counts), tail_class, np.int16)
    own[-1] = end_class
    if clustered:
        pairs = learn.mapInArrow(_pairs(clustered), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        matrix = np.zeros(clustered * clustered)
        matrix[pairs.column(0).to_numpy()] = pairs.column(1).to_numpy()
        own[:clustered] = exchange(matrix.reshape(clustered, clustered), classes)

    # tokens without numbers, with their counts; words seen once stay in TAIL
    spots = coded.where(F.size("tail") > 0).select("row", "training", F.posexplode("tail").alias("pos", "word")).join(words, "word")
    spots = scratch.keep(spots.select("row", "training", "pos", "word", "n"), "spots", compression="zstd")
    beside = coded.where(F.size("tail") > 0).select("row", "training", "before", "after")
    numbered = sum(r["words"] for r in levels)
    others = numbered > len(hashes)  # words seen twice that have no number

    if others:  # each such word once with all its places in texts that teach: at most about tokens / head_words
        places = spots.where("training and n > 1").groupBy("word", "n").agg(F.collect_list(F.struct("row", "pos")).alias("places"))
        places = scratch.keep(places, "places", compression="zstd")

    def taught(kinds):
        """The places of words seen twice in texts that teach, with their classes: words are joined, not their tokens."""
        if kinds is None:
            return spots.where("training and n > 1").withColumn("class", F.lit(tail_class))
        return places.join(kinds, "word").select("word", "n", "class", F.explode("places").alias("place")).select("place.*", "word", "n", "class")

    def with_seen(of, known):
        lists = known.groupBy("row").agg(F.collect_list(F.struct("pos", "word", "n", F.col("class").cast("int").alias("class"))).alias("seen"))
        joined = of.drop("training").join(lists, "row", "left")
        return joined.withColumn("seen", F.coalesce("seen", F.array().cast("array<struct<pos:int,word:bigint,n:bigint,class:int>>")))

    event = "tail boolean, word long, own int, slot int, n long"

    def contexts(sent, kinds, named):
        one = learn.mapInArrow(_contexts(sent, width, named), event)
        known = taught(kinds) if others else spots.where("training").withColumn("class", F.lit(tail_class))
        two = with_seen(beside.where("training"), known).mapInArrow(_tail_contexts(sent, width, named), event)
        return one.unionByName(two)

    def table_of(found):
        got = found.where(F.col("slot") < width).groupBy("own", "slot").agg(F.sum("n").alias("n")).collect()
        table = np.zeros((width, width))
        for r in got:
            table[r["own"], r["slot"]] = r["n"]
        return table

    kinds, best, turn = None, None, 0
    while True:
        sent = sc.broadcast(own)
        last = turn == rounds or not numbered
        if last:
            table = table_of(contexts(sent, kinds, False))
        else:
            found = contexts(sent, kinds, True).repartition("tail", "word").groupBy("tail", "word", "own", "slot").agg(F.sum("n").alias("n"))
            found = scratch.keep(found, f"contexts-{turn}")
            table = table_of(found)
        if best is not None and turn > 1 and told(table) < told(best[0]):
            table, own, kinds = best
            break
        best = table, own, kinds
        if last:
            break
        lists = found.where((F.col("word") >= 0) | F.col("tail")).groupBy("tail", "word", "own").agg(F.collect_list(F.struct("slot", "n")).alias("seen"))
        chosen = lists.mapInArrow(_chosen(sc.broadcast((table, hashes)), turn), "tail boolean, word long, class int")
        if not turn and clustered:  # the first round is for words without a class
            start = F.col("tail") | (F.col("word") >= clustered)
            chosen = chosen.where(start)
        chosen = scratch.keep(chosen, f"classes-{turn}")
        scratch.drop(f"contexts-{turn}")
        moved = chosen.where("not tail").select("word", "class").toArrow()
        own = own.copy()
        own[moved.column(0).to_numpy()] = moved.column(1).to_numpy()
        kinds = chosen.where("tail").select("word", "class")
        turn += 1

    share = (table.sum(0) + 1) / (table.sum() + width)
    steps = np.log10((table + PULL * share) / (table.sum(1, keepdims=True) + PULL))
    model = sc.broadcast(ClassModel(counts, own, steps, table.sum(0), int(all_tokens) + texts, int(all_words) + (texts > 0), int(all_words) - numbered))
    schema = "row long, doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double"
    scores = coded.select("row", "doc_id", "training", "ids").mapInArrow(_scores(model), schema)
    known = spots.withColumn("class", F.lit(tail_class))
    if others and kinds is not None:
        known, once = spots.where("n > 1 and not training").join(kinds, "word"), known.where("n = 1")
        known = known.unionByName(taught(kinds), allowMissingColumns=True).unionByName(once)
    more = with_seen(beside, known).mapInArrow(_tail_scores(model), "row long, more_known long, more_base double, more_score double")
    out = scores.join(more, "row", "left")
    return out.select(
        "doc_id",
        "training",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(all_tokens) + texts).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
