"""Language of texts by unigram models over the pieces of a public vocabulary, all segmentations summed.

Each language has a probability for every piece of one fixed vocabulary. A word's probability is the sum
over all ways to cut it into pieces, by a forward pass over its bytes; a text's is the product over its words.
Single bytes are always pieces, so every word has a segmentation. The piece probabilities are fitted by
expectation maximisation on the word counts of a bounded sample of labelled texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeskein.llm._tables import Scratch
from codeskein.llm._words import M1, buffers, column, mix, pieces, span_hashes, word_spans

LONGEST = 16
SAMPLE_TEXTS = 2000
EM_STEPS = 2
SMOOTH = 0.05
TRAIN_WORD = 64
PIECE, PIECE_STEP = 12, 8
LONG_WORD = 512
UNDETERMINED = "und"


class Pieces:
    """The vocabulary: which byte spans are pieces. A leading space marks the start of a word.

    Pieces of more than 16 bytes and pieces with a space inside are left out.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = {bytes([b]) for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                got = model.id_to_piece(i).replace("▁", " ").encode()
                if 0 < len(got) <= LONGEST and b" " not in got[1:]:
                    texts.add(got)
        ordered = sorted(texts, key=lambda t: (len(t), t))
        self.size = len(ordered)
        joined = np.frombuffer(b"".join(ordered), np.uint8)
        length = np.array([len(t) for t in ordered])
        start = np.cumsum(length) - length
        self.keys, self.ids = {}, {}
        self.maybe = np.zeros((LONGEST + 1, 1 << 18), bool)
        for n in range(1, LONGEST + 1):
            own = np.flatnonzero(length == n)
            keys = self._keys(joined, start[own], n)
            order = np.argsort(keys)
            self.keys[n], self.ids[n] = keys[order], own[order]
            self.maybe[n, self._slot(keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * M1 >> np.uint64(46)).astype(np.int64)

    @staticmethod
    def _keys(data: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        return span_hashes(data, start, start + n) if len(start) else np.zeros(0, np.uint64)

    def at(self, data: np.ndarray, left: np.ndarray) -> np.ndarray:
        """ids[i, n]: 1 + the piece of the n + 1 bytes from i on, 0 if there is none or it leaves the word.

        `left` holds the bytes from i to the end of its word.
        """
        out = np.zeros((len(data), LONGEST), np.int32)
        for n in range(1, LONGEST + 1):
            where = np.flatnonzero(left >= n)
            keys = self._keys(data, where, n)
            hit = self.maybe[n, self._slot(keys)]
            where, keys = where[hit], keys[hit]
            place = np.minimum(np.searchsorted(self.keys[n], keys), len(self.keys[n]) - 1)
            real = self.keys[n][place] == keys
            out[where[real], n - 1] = self.ids[n][place[real]] + 1
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words, each after one space, and the n + 1 offsets."""
    size = ends - starts + 1
    off = np.concatenate([[0], np.cumsum(size)])
    out = np.full(off[-1], 32, np.uint8)
    take = np.repeat(starts - off[:-1] - 1, size) + np.arange(off[-1])
    inside = np.ones(off[-1], bool)
    inside[off[:-1]] = False
    out[inside] = data[take[inside]]
    return out, off


def log_sums(vocab: Pieces, data: np.ndarray, off: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """ln of the summed probability of all segmentations, (words, languages). chance: (1 + pieces, languages).

    Words of a chunk advance together, longest first; words above LONG_WORD bytes go one by one.
    """
    n, langs = len(off) - 1, chance.shape[1]
    size = np.diff(off)
    out = np.zeros((n, langs))
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = _long_sum(vocab, data[off[i] : off[i + 1]], chance)
    short = np.flatnonzero(size <= LONG_WORD)
    short = short[np.argsort(-size[short], kind="stable")]
    step = 20_000
    for a in range(0, len(short), step):
        own = short[a : a + step]
        length = size[own]
        begin = np.cumsum(length) - length
        take = np.repeat(off[own] - begin, length) + np.arange(length.sum())
        ids = vocab.at(data[take], np.repeat(begin + length, length) - np.arange(len(take)))
        ring = np.zeros((LONGEST, len(own), langs))
        ring[0] = 1.0
        scale = np.zeros((len(own), langs))
        for at in range(1, int(length[0]) + 1 if len(own) else 0):
            live = int(np.searchsorted(-length, -at, "right"))
            new = np.zeros((live, langs))
            for n_bytes in range(1, min(LONGEST, at) + 1):
                piece = ids[begin[:live] + at - n_bytes, n_bytes - 1]
                hit = np.flatnonzero(piece)
                if len(hit):
                    new[hit] += ring[(at - n_bytes) % LONGEST, hit] * chance[piece[hit]]
            ring[at % LONGEST, :live] = new
            if at % 8 == 0:
                top = ring[:, :live].max(0)
                ring[:, :live] /= top
                scale[:live] += np.log(top)
            ends = np.flatnonzero(length[:live] == at)
            out[own[ends]] = np.log(new[ends] if at % 8 else ring[at % LONGEST, ends]) + scale[ends]
    return out


def _long_sum(vocab: Pieces, word: np.ndarray, chance: np.ndarray) -> np.ndarray:
    langs, block = chance.shape[1], 1 << 14
    alpha = np.zeros((LONGEST + block, langs))
    alpha[LONGEST - 1] = 1.0  # row LONGEST - 1 + i: the first i bytes of the block
    scale = np.zeros(langs)
    back = np.arange(LONGEST)
    for a in range(0, len(word), block):
        lo, hi = max(0, a - LONGEST), min(len(word), a + block)
        part = word[lo:hi]
        ids = vocab.at(part, len(part) - np.arange(len(part)))
        for at in range(a + 1, hi + 1):
            row = LONGEST - 1 + at - a
            n = min(LONGEST, at)
            p = chance[ids[at - lo - 1 - back[:n], back[:n]]]
            alpha[row] = (alpha[row - n : row][::-1] * p).sum(0)
            if at % 8 == 0:
                top = alpha[row - LONGEST + 1 : row + 1].max(0)
                alpha[row - LONGEST + 1 : row + 1] /= top
                scale += np.log(top)
        row = LONGEST - 1 + hi - a
        alpha[:LONGEST] = alpha[row - LONGEST + 1 : row + 1].copy()
    return np.log(alpha[LONGEST - 1]) + scale


def expected_pieces(vocab: Pieces, data: np.ndarray, off: np.ndarray, times: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in words that occur `times` times, under one language's chances."""
    out = np.zeros(vocab.size + 1)
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    for a in range(0, len(order), 20_000):
        own = order[a : a + 20_000]
        length, top = size[own], int(size[own[0]])
        begin = np.cumsum(length) - length
        take = np.repeat(off[own] - begin, length) + np.arange(length.sum())
        ids = vocab.at(data[take], np.repeat(begin + length, length) - np.arange(len(take)))
        alpha = np.zeros((top + 1, len(own)))
        beta = np.zeros((top + 1, len(own)))
        alpha[0] = 1.0
        beta[length, np.arange(len(own))] = 1.0
        steps = []
        for at in range(1, top + 1):
            live = int(np.searchsorted(-length, -at, "right"))
            for n in range(1, min(LONGEST, at) + 1):
                piece = ids[begin[:live] + at - n, n - 1]
                hit = np.flatnonzero(piece)
                if len(hit):
                    steps.append((at, n, hit, piece[hit]))
                    alpha[at, hit] += alpha[at - n, hit] * chance[piece[hit]]
        for at, n, hit, piece in reversed(steps):
            beta[at - n, hit] += beta[at, hit] * chance[piece]
        whole = alpha[length, np.arange(len(own))]
        weight = np.divide(times[own], whole, out=np.zeros(len(own)), where=whole > 1e-290)
        for at, n, hit, piece in steps:
            out += np.bincount(piece, alpha[at - n, hit] * chance[piece] * beta[at, hit] * weight[hit], vocab.size + 1)
    return out


class LanguageModel:
    """Languages in code point order, their shares, and (1 + pieces, languages) piece chances."""

    def __init__(self, names: list[str], shares: np.ndarray, chance: np.ndarray, vocab_path: str):
        self.names, self.shares, self.chance, self.vocab_path = names, shares, chance, vocab_path


def fit_languages(
    docs: DataFrame, training: Column, vocab_path: str | None = None, sample_texts: int = SAMPLE_TEXTS, em_steps: int = EM_STEPS
) -> LanguageModel:
    """Fit on about `sample_texts` texts of each language, taken by a hash of id and text among rows where `training`.

    Null texts and languages teach nothing. Runs of more than TRAIN_WORD bytes without white space, as scripts without spaces have
    them, teach by overlapping pieces of PIECE code points; scoring takes them whole. The driver holds one number per language and piece.
    """
    spark = docs.sparkSession
    vocab_path = vocab_path or default_vocabulary()
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    size = vocabulary(vocab_path).size
    chance = np.zeros((size + 1, len(names)))
    chance[1:] = 1 / size
    shares = np.array([sizes[n] for n in names], float) / max(1, sum(sizes.values()))
    if not names:
        return LanguageModel(names, shares, chance, vocab_path)
    part = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(min(1.0, sample_texts / sizes[n])))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    words = rows.where(draw < part[F.col("lang")]).select(
        "lang", F.explode(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+")).alias("word")
    )
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1)), F.lit(PIECE_STEP)), lambda i: F.substring("word", i, F.lit(PIECE)))
    words = words.select("lang", F.explode(F.when(F.octet_length("word") <= TRAIN_WORD, F.array("word")).otherwise(cuts)).alias("word"))
    words = words.where(F.octet_length("word") > 0).groupBy("lang", "word").agg(F.count("*").alias("n"))
    scratch = Scratch(spark, "language")
    words = scratch.keep(words, "words")
    for _ in range(em_steps):
        now = spark.sparkContext.broadcast(chance)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab = vocabulary(vocab_path)
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                langs = batch.column(0).to_pylist()
                for lang in set(langs):
                    own = batch.filter(pa.array([x == lang for x in langs]))
                    data, off = buffers(column(own, "word"))
                    data, off = _spaced(data, off[:-1], off[1:])
                    times = own.column(2).to_numpy().astype(float)
                    got = expected_pieces(vocab, data, off, times, now.value[:, names.index(lang)])
                    total[lang] = total.get(lang, 0) + got
            for lang, got in total.items():
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(got[at])], names=["lang", "piece", "uses"])

        uses = words.mapInArrow(count, "lang string, piece long, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
        fresh = np.zeros_like(chance)
        for lang, own in uses.toPandas().groupby("lang"):
            fresh[own["piece"].to_numpy(), names.index(lang)] = own["uses"].to_numpy()
        fresh[1:] += SMOOTH
        chance = fresh / fresh[1:].sum(0)
        now.unpersist()
    scratch.drop("words")
    return LanguageModel(names, shares, chance, vocab_path)


class _Known:
    """Scores of words met so far in this worker, by hash; emptied when it holds `keep`."""

    def __init__(self, langs: int, keep: int = 400_000):
        self.keep = keep
        self.hashes, self.scores = np.zeros(0, np.uint64), np.zeros((0, langs))

    def scored(self, hashes, score) -> np.ndarray:
        place = np.searchsorted(self.hashes, hashes)
        place[place == len(self.hashes)] = 0
        known = self.hashes[place] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        out = np.empty((len(hashes), self.scores.shape[1]))
        out[known] = self.scores[place[known]]
        new = np.flatnonzero(~known)
        out[new] = score(new)
        if len(self.hashes) + len(new) > self.keep:
            self.hashes, self.scores = hashes, out
        else:
            h = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(h)
            self.hashes, self.scores = h[order], np.concatenate([self.scores, out[new]])[order]
        return out


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`docs` with `lang_pred` and `score`, the share of the likeliest language among all, 0 to 1.

    A null text, or one without a letter, is `und` with score 0; ties go to the first name. Nothing but `text`
    is looked at; other columns pass unchanged, but for ones named lang_pred or score, which are replaced.
    """
    passed = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*passed)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        vocab, known = vocabulary(model.vocab_path), _Known(len(model.names))
        prior = np.log(np.maximum(model.shares, 1e-9))
        for batch in pieces(batches):
            texts = pc.utf8_lower(column(batch, "text"))
            n = len(texts)
            best, score = np.zeros(n, int), np.zeros(n)
            letters = np.array(pc.match_substring_regex(texts, r"\p{L}"), bool) & bool(model.names)
            if model.names:
                data, off = buffers(texts)
                starts, ends, word_off = word_spans(data, off)
                _, at, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                hashes = span_hashes(data, starts[at], ends[at])

                def score_new(new, data=data, a=starts[at], b=ends[at]):
                    return log_sums(vocab, *_spaced(data, a[new], b[new]), model.chance)

                each = known.scored(hashes, score_new)
                sums = np.zeros((n, len(model.names)))
                some = np.flatnonzero(np.diff(word_off))
                for k in range(len(model.names) if len(some) else 0):
                    sums[some, k] = np.add.reduceat(each[back, k], word_off[some])
                sums += prior
                best = sums.argmax(1)
                score = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            names = np.array([*model.names, UNDETERMINED], object)
            pred = pa.array(names[np.where(letters, best, len(model.names))], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pred, pa.array(np.where(letters, score, 0.0))], names=[*batch.schema.names, "lang_pred", "score"]
            )

    schema = out.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    return out.mapInArrow(rows, schema)
