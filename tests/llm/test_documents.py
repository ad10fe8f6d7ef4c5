"""Operators on documents: against plain versions on the whole small table, and on odd rows."""

import hashlib
import json
import zlib

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeskein.llm import class_lm, fingerprints, language, licenses, mixing, near_copies, personal, token_files
from codeskein.llm._tables import Scratch
from codeskein.llm.decontaminate import contaminated
from codeskein.llm.op_queries import QUERIES


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# licences


def test_alignment_is_a_patience_one():
    assert licenses.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    assert licenses.aligned([9, 1, 2, 7, 3, 9], [1, 2, 3]) == [(1, 0), (2, 1), (4, 2)]
    assert licenses.aligned([1, 1, 5, 1], [1, 5]) == [(0, 0), (2, 1)]
    assert licenses.aligned([], [1]) == []


def test_licenses_in_texts(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    words = mit.split()
    changed = " ".join(words[:20] + ["other", "words"] + words[24:60] + words[63:])
    texts = [mit, "before\n" + changed + "\nafter", "Released under the MIT licence.", "Released under the MIT License. and again\nReleased under the MIT License.", "license the of", None, ""]
    got = rows_of(licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    by = {(r["doc_id"], r["license"]): r for r in got}
    assert by[0, "MIT-text"]["coverage"] == 1.0 and 0.8 <= by[1, "MIT-text"]["coverage"] < 1.0
    assert by[2, "MIT"]["coverage"] == 0.8
    assert by[3, "MIT"]["copies"] == 2
    at = by[3, "MIT"]
    assert texts[3][at["start"] : at["end"]] == "Released under the MIT License"
    assert {d for d, _ in by} == {0, 1, 2, 3}


def test_licenses_whose_changed_word_stands_elsewhere(spark):
    """The rarest template word of the text is not part of the notice."""
    filler = " ".join(f"w{i} the of" for i in range(60))
    others = " ".join(f"under {i} the {i} MIT {i} license {i}" for i in (1, 2))
    mit = licenses.TEMPLATES["MIT-text"].split()
    gone = [w for w in mit if w != "sublicense,"]
    texts = [
        f"released {filler} {filler} Distributed under the MIT License {filler} license of {others}",
        f"sublicense {filler} {' '.join(gone)} {filler} {' '.join(gone)} {' '.join(mit[:40])}",
        f"released {filler} under {filler} {others}",
    ]
    got = rows_of(licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    by = {(r["doc_id"], r["license"]): r for r in got}
    at = by[0, "MIT"]
    assert at["coverage"] == 0.8 and texts[0][at["start"] : at["end"]] == "under the MIT License"
    assert by[1, "MIT-text"]["coverage"] > 0.98 and by[1, "MIT-text"]["copies"] == 2


def test_licenses_of_the_table(spark, folder, documents):
    got = rows_of(QUERIES["op1_licenses"](spark, folder))
    assert {r["doc_id"] for r in got} == {d for d, t in documents if "icense" in t}


# personal data


@pytest.mark.parametrize(
    "text",
    [
        "a@b.c x@y.z@q.w @a.b a@b a@-.-", "1.2.3.4.5.6.7.8.9 256.1.1.1 01.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1112",
        "+1 (743) 555-3824 +49 30 1234567 +1 +12", "+1+22 333 4444 555", "9" * 3000 + "." + "1" * 5000, "a" * 5000 + "@" + "b" * 5000, "",
    ],
)
def test_rules_are_the_patterns(text):
    assert personal.base_spans(text) == plain.personal(text)


def test_personal_data_of_the_table(spark, folder, documents):
    got = {r["doc_id"]: r for r in rows_of(QUERIES["op2_personal_data"](spark, folder))}
    assert len(got) == len(documents)
    for d, t in documents:
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain.personal(t))
        assert got[d]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(got[d]["spans"].split(","))


def test_boosted_trees_learn_and_calibrate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 10, (4000, 24)).astype(float)
    x[:, 0] = 0
    y = ((x[:, 3] > 4) ^ (x[:, 7] > 6)).astype(float)
    model = personal.calibrated(personal.Boosted().fit(x[:2000], y[:2000]), x[2000:], y[2000:])
    p = model.probability(x[2000:])
    assert ((p > 0.5) == (y[2000:] > 0)).mean() > 0.95
    assert set(model.thresholds) == {"email"}


def test_candidates_beyond_the_rules_are_added_and_redacted(spark):
    sure = personal.Boosted()
    sure.base, sure.trees, sure.cuts = 9.0, [], [np.zeros(0)] * 24
    text = "call (743) 555-3824 or +1 743 555 3824 now, me@home.org"
    model = personal.CandidateModel(sure, thresholds={"phone": 0.9})
    found = personal.personal_data(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), model)
    one, two = sorted(rows_of(personal.redacted(found)), key=lambda r: r["doc_id"])
    assert one["text"] == "call [PHONE] or [PHONE] now, [EMAIL]" and two["text"] is None and two["spans"] == []
    assert len(one["base_spans"]) == 2 and len(one["spans"]) == 3


# token files


def test_boundaries():
    for lengths in ([], [0], [1, 0, 0, 5], [3] * 1000, np.random.default_rng(0).integers(0, 5000, 3000)):
        values = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        ids = np.arange(values[-1]) % 50257
        got, ef = token_files.unpack(token_files.pack(ids, np.array(lengths, np.int64)))
        assert (got == ids).all() and (ef.decode() == values).all()
        assert [ef.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()
    assert 8 * (len(ef.low) + len(ef.high)) < 16 * len(values)


def test_ids_are_the_librarys():
    import public_tokenizers

    coder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"), keep=12)
    texts = ["", "  ", "a  b\n\n\n c\n d \n", "\n\nx", " <|endoftext|> don't it's \t\x0b y z", "日本語 é́ 😀 x", "a\x1cb \x1f c", "nb sp   x", "tail   "] * 2
    ids, edge = coder.encode(pa.array(texts, pa.large_string()))
    want = coder.tok.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:])] == [e.ids for e in want]


def test_added_tokens_in_texts_have_their_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "a <|endo ftext|> b", "<|endoftext|>", "c\n\n<|endoftext|><|endoftext|> \x1c", "plain words"]
    ids, edge = token_files.Encoder(path).encode(pa.array(texts, pa.large_string()))
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    got = [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:])]
    assert got == [e.ids for e in want] and len(got[0]) == 4


def test_token_files_of_the_table(spark, folder, documents):
    import public_tokenizers

    tok = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json")).tok
    got = {r["doc_id"]: r for r in rows_of(QUERIES["op4_token_files"](spark, folder))}
    start = 0
    for (d, _), e in zip(documents, tok.encode_batch([t for _, t in documents], add_special_tokens=False)):
        ids = np.array([*e.ids, 2], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_small_shards(spark, documents):
    import public_tokenizers

    docs = spark.createDataFrame(documents[:60], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = token_files.Scratch(spark, "shards")
    shards = token_files.write_token_files(docs, folder, path, shard_ids=500)
    assert shards.count() > 20
    got = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in rows_of(token_files.read_token_files(shards)))
    assert got == sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in rows_of(token_files.token_ids(docs)))


# near copies


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    values = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    b[:200] = a[:200]
    marks = near_copies.signatures(np.concatenate([values, values]), np.concatenate([a, b]), np.array([0, 300, 600]), 4000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((marks[0] == marks[1]).mean() - want) < 0.03


def test_components_of_a_chain_and_a_star(spark):

    links = [(bytes([i]), bytes([i + 1])) for i in range(10, 40)] + [(bytes([100]), bytes([i])) for i in range(101, 140)]
    df = spark.createDataFrame(links, "a binary, b binary")
    got = {r["node"][0]: r["comp"][0] for r in rows_of(near_copies.components(df, Scratch(spark, "chain"), "c"))}
    assert got == {i: 10 for i in range(10, 41)} | {i: 100 for i in range(100, 140)}


def test_components_in_small_chunks_equal_a_plain_union(spark, monkeypatch):
    order = np.random.default_rng(1).permutation(900).tolist()
    pairs = [(order[i], order[i + 1]) for i in range(299)] + [(order[300], order[i]) for i in range(301, 600)]
    pairs += [(order[i], order[i + i % 4]) for i in range(600, 890, 3)]  # pairs with themselves too
    names = {x: hashlib.md5(str(x).encode()).digest() for x in order}
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in ((names[x], names[y]) for x, y in pairs if x != y):
        low, high = sorted((top(a), top(b)))
        up[high] = low
    df = spark.createDataFrame([(bytearray(names[x]), bytearray(names[y])) for x, y in pairs], "a binary, b binary").repartition(7)
    for chunk in (20, 1 << 19):
        monkeypatch.setattr(near_copies, "CHUNK", chunk)
        got = rows_of(near_copies.components(df, Scratch(spark, "chunks"), "c"))
        assert {bytes(r["node"]): bytes(r["comp"]) for r in got} == {x: top(x) for x in up} and len(got) == len(up)
    assert not rows_of(near_copies.components(df.where("a IS NULL"), Scratch(spark, "none"), "c"))


def test_near_copies_of_the_table(spark, folder, documents):
    got = {r["doc_id"]: r["class_id"] for r in rows_of(QUERIES["op5_near_copies"](spark, folder))}
    assert got == plain.near_classes(documents)


def test_a_large_group_with_distances_on_both_sides_of_the_bound(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        text = list(base)
        for j in rng.choice(120, rng.integers(0, 7), replace=False):
            text[j] = f"x{rng.integers(1 << 30)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in rows_of(near_copies.near_copies(df))}
    assert got == plain.near_classes(rows)


# mixture


def test_mixture_of_the_table(spark, folder, documents):
    got = {r["doc_id"]: r for r in rows_of(QUERIES["op6_mixture"](spark, folder))}
    source = {r["doc_id"]: r["source"] for r in rows_of(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source"))}
    sizes = {d: len(plain.words(t)) for d, t in documents}
    totals = {}
    for d, s in source.items():
        totals[s] = totals.get(s, 0) + sizes[d]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(totals, key=lambda s: (s is None, s)))}
    left, budget, target = set(totals), 1.5 * sum(totals.values()), {}
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * totals[s]}
        if not over:
            break
        target |= {s: 2.0 * totals[s] for s in over}
        left -= over
    target |= {s: level * weight[s] for s in left}
    for d, r in got.items():
        assert (r["size"], r["source_size"]) == (sizes[d], totals[source[d]])
        assert r["target"] == pytest.approx(target[source[d]])
        assert r["taken"] in (r["size"] * int(target[source[d]] / totals[source[d]]), r["size"] * (int(target[source[d]] / totals[source[d]]) + 1))
    again = {r["doc_id"]: r["taken"] for r in rows_of(QUERIES["op6_mixture"](spark, folder))}
    assert again == {d: r["taken"] for d, r in got.items()}


def test_shares_come_near_on_many_rows(spark):
    docs = spark.range(30_000).selectExpr("id doc_id", "concat('s', id % 7) source", "cast(1 + id % 50 as long) n")
    mix = mixing.mixed(docs, size=F.col("n"))
    for r in rows_of(mix.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("took"), F.first("target").alias("target"))):
        assert abs(r["took"] / r["target"] - 1) < 0.005
    assert mixing.emitted(mix).count() == mix.agg(F.sum("copies")).first()[0]
    assert mixing.emitted(mix).columns == docs.columns


def test_a_document_is_drawn_with_the_fraction_as_its_probability(spark):
    docs = spark.range(3_000).selectExpr("id doc_id", "concat('s', lpad(id, 4, '0')) source", "10L n")
    mix = mixing.mixed(docs, size=F.col("n"))
    groups = rows_of(mix.groupBy(F.round(F.col("target") / F.col("source_size"), 6).alias("rate")).agg(F.avg("copies").alias("mean"), F.count("*").alias("n")))
    assert len(groups) > 1
    for r in groups:
        part = r["rate"] % 1
        assert abs(r["mean"] - r["rate"]) <= 4 * (part * (1 - part) / r["n"]) ** 0.5 + 1e-6
    one = docs.selectExpr("doc_id", "'s' source", "1 + doc_id % 9 n")  # and a source of one size level each
    mix = mixing.mixed(one.unionByName(one), size=F.col("n"), share=0.3)
    got = rows_of(mix.groupBy("size").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")))
    assert all(abs(r["copies"] / 2 - 0.3 * r["n"] / 2) <= 1 for r in got) and sum(r["n"] for r in got) == 6_000


# language models


def test_language_model_scores_held_out_texts_better_than_the_unigram(spark, folder, documents):
    got = rows_of(QUERIES["op7_class_scores"](spark, folder))
    train = [plain.words("".join(c.lower() if "A" <= c <= "Z" else c for c in t)) + ["</s>"] for d, t in documents if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = plain.Counter(w for t in train for w in t)
    n, v = sum(counts.values()), len(counts)
    texts = dict(documents)
    for r in got:
        own = plain.words("".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r["doc_id"]])) + ["</s>"]
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(own), n, sum(counts[w] > 0 for w in own))
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in own))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_class_model_is_a_distribution(spark):
    texts = ["a b a c", "b a b d e", "c c a f", "a b c g"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    probe = spark.createDataFrame([(100 + i, w) for i, w in enumerate([*"abcdefg", ""])], "doc_id long, text string")
    got = rows_of(class_lm.scored_texts(docs.unionByName(probe), F.col("doc_id") < 100, head_words=3, clustered=3, classes=2))
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in got) and len(got) == 20


def test_best_class_is_the_one_that_tells_most():
    rng = np.random.default_rng(5)
    pairs = rng.poisson(1.5, (12, 12)).astype(float)
    own = np.append(rng.integers(0, 3, 10), [3, 4])  # TAIL and the end
    own[2] = 3  # not placed yet
    member = np.eye(5)[own]
    got = class_lm.best_classes(member.T @ pairs @ member, own, pairs @ member, pairs.T @ member, np.diag(pairs))
    for w in range(10):
        worth = []
        for c in range(3):
            moved = np.eye(5)[np.where(np.arange(12) == w, c, own)]
            worth.append(class_lm.told(moved.T @ pairs @ moved))
        assert worth[got[w]] == pytest.approx(max(worth))


def test_words_beyond_the_first_set_take_classes_from_both_sides(spark):
    """Words of two kinds alternate, but for those of a third that no frequent word stands before."""
    rng = np.random.default_rng(4)
    texts = []
    for i in range(300):
        texts.append(" ".join(f"{'ab'[(i + k) % 2]}{rng.integers(0, 12)}" for k in range(40)))
    texts += [f"p{i % 20} a{rng.integers(0, 12)} b{rng.integers(0, 12)}" for i in range(200)] + [f"q{i % 20} b{rng.integers(0, 12)} a{rng.integers(0, 12)}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    probe = spark.createDataFrame([(1000, "p3 a1"), (1001, "p3 b1"), (1002, "q3 b1"), (1003, "q3 a1")], "doc_id long, text string")
    runs = []
    for head in (1_000_000, 30):
        got = class_lm.scored_texts(docs.unionByName(probe), F.col("doc_id") < 1000, head_words=head, clustered=8, classes=6)
        runs.append({r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in rows_of(got)})
    assert runs[0][1000][0] > runs[0][1001][0] + 0.2 and runs[0][1002][0] > runs[0][1003][0] + 0.2
    assert all(runs[0][d] == pytest.approx(x) for d, x in runs[1].items())


def test_rounds_join_words_with_their_classes_not_their_tokens(spark, monkeypatch):
    """Beyond the first set 60 words occur 20 times each; a join of tokens makes 1,200 rows, which only that with the counts may."""
    texts = [" ".join(f"w{(i * 7 + k * k) % 60}" for k in range(12)) for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, join = [], type(docs).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        made.extend([out.count()] if on == "word" else [])
        return out

    monkeypatch.setattr(type(docs), "join", counted)
    got = rows_of(class_lm.scored_texts(docs, F.lit(True), head_words=1, clustered=1, classes=4))
    assert len(got) == 100 and made[0] > 1_000 and len(made) > 3
    assert all(n <= 60 for n in made[1:])


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(2)
    side = rng.integers(0, 2, 40)
    pairs = rng.poisson(np.where(side[:, None] != side[None, :], 30, 1)).astype(float)
    own = class_lm.exchange(pairs, 2)
    assert (own == side).all() or (own != side).all()


def test_segmentations_are_summed():
    vocab = language.vocabulary(language.default_vocabulary())
    rng = np.random.default_rng(0)
    chance = rng.random((vocab.size + 1, 2)) * 0.1
    chance[0] = 0
    pieces = {}
    words = [b" the", b" \xc3\xa9t\xc3\xa9", b" q", b" international"]
    data = np.frombuffer(b"".join(words), np.uint8)
    off = np.cumsum([0, *map(len, words)])
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(data))
    ids = vocab.at(data, left)
    got = language.log_sums(vocab, data, off, chance)
    for k, (a, b) in enumerate(zip(off[:-1], off[1:])):
        alpha = np.zeros((b - a + 1, 2))
        alpha[0] = 1
        for i in range(1, b - a + 1):
            for n in range(1, min(16, i) + 1):
                piece = ids[a + i - n, n - 1]
                if piece:
                    pieces[piece] = 1
                    alpha[i] += alpha[i - n] * chance[piece]
        assert np.allclose(got[k], np.log(alpha[-1]))
    assert len(pieces) > 20
    long = np.frombuffer(b" " + b"ab cd".replace(b" ", b"") * 300, np.uint8)
    whole = language._long_sum(vocab, long, chance)
    assert np.allclose(whole, _unscaled(vocab, long, chance))


def _unscaled(vocab, word, chance):
    ids = vocab.at(word, len(word) - np.arange(len(word)))
    alpha = [np.zeros(2)]
    for i in range(1, len(word) + 1):
        alpha.append(np.logaddexp.reduce([alpha[i - n] + np.log(chance[ids[i - n, n - 1]]) for n in range(1, min(16, i) + 1) if ids[i - n, n - 1]]))
    return alpha[-1]


def test_languages_of_held_out_texts(spark, folder):
    truth = {r["doc_id"]: r["lang"] for r in rows_of(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"))}
    got = rows_of(QUERIES["op10_language"](spark, folder))
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_without_spaces_are_learned(spark):
    rng = np.random.default_rng(8)
    letters = {"first": [chr(0x4E00 + i) for i in range(0, 400, 2)], "second": [chr(0x4E00 + i) for i in range(100, 500, 2)], "third": [chr(0x0E01 + i) for i in range(40)]}

    def text(lang):
        return "".join(rng.choice(letters[lang], 120))

    rows = [(i, text(lang), lang) for i, lang in enumerate(sorted(letters) * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_languages(docs, F.col("doc_id") < 240)
    got = {r["doc_id"]: r["lang_pred"] for r in rows_of(language.predict_languages(docs.where("doc_id >= 240").select("doc_id", "text"), model))}
    assert len(got) == 60 and sum(got[i] == lang for i, _, lang in rows if i >= 240) >= 57


# fingerprints


def test_span_equality_and_extension():
    a, b = fingerprints.PrefixHash("the cat sat on the mat"), fingerprints.PrefixHash("a cat sat on a mat")
    assert a.span(4, 10) == b.span(2, 10) and a.span(0, 3) == a.span(15, 3) and a.span(0, 3) != a.span(1, 3)
    assert a.extension(4, b, 2) == len("cat sat on ") and a.extension(0, b, 0) == 0


def test_likeness():
    prints = fingerprints.fingerprints(["", "a", "abcd" * 100, "abcd" * 75 + "x" * 100, "z" * 400, "abcd" * 100])
    assert prints[2] == prints[5] and fingerprints.likeness(prints[2], prints[5]) == 1.0
    assert 0.7 < fingerprints.likeness(prints[2], prints[3]) <= 0.75 and fingerprints.likeness(prints[2], prints[4]) < 0.1
    assert fingerprints.likeness(prints[0], prints[1]) == 0.0 and fingerprints.likeness(prints[0], prints[0]) == 1.0


def test_likeness_survives_insertions():
    rng = np.random.default_rng(6)
    text, other = ("".join(chr(97 + c) for c in rng.integers(0, 26, 6400)) for _ in range(2))
    changed = ["x" + text, text[:3000] + " more words " + text[3000:], text[:200] + text[230:], text[3200:] + text[:3200], text * 3]
    first, unlike, *prints = fingerprints.fingerprints([text, other, *changed])
    assert all(fingerprints.likeness(first, p) > 0.9 for p in prints[:4]) and 0.2 < fingerprints.likeness(first, prints[4]) <= 1 / 3
    assert fingerprints.likeness(first, unlike) < 0.02


def test_fingerprints_of_the_table(spark, folder, documents):
    got = {r["doc_id"]: r for r in rows_of(QUERIES["op8_fingerprints"](spark, folder))}
    assert {d: r["edited_sha256"] for d, r in got.items()} == plain.edited(documents)
    assert all(r["near_edited"] > 0.6 for r in got.values() if r["n_chars"] > 100)


# benchmark leaks


def test_leaks_of_the_table(spark, folder, documents):
    items = [(r["item_id"], r["text"]) for r in rows_of(spark.read.parquet(f"{folder}/benchmark.parquet"))]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows_of(QUERIES["op9_benchmark_leaks"](spark, folder))}
    assert got == pytest.approx(plain.leaks(documents, items))


def test_changed_repeated_and_short_leaks(spark):
    item = [f"w{i}" for i in range(60)]
    texts = [
        " ".join(["a"] * 9 + item + ["b"] * 9),
        " ".join(item[:30] + ["new"] + item[31:]),
        " ".join(item[:54]),
        " ".join(item[:40]),
        " ".join(item + ["x"] + item),
        "p q",
        "o p q r",
        " ".join(item[:20] + ["n1"] + item[21:40] + ["n2"] + item[41:]),
    ]
    rows = list(enumerate(texts))
    items = [(0, " ".join(item)), (1, "p q"), (2, None), (3, ""), (4, "zz")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows_of(contaminated(docs, bench))}
    assert got == pytest.approx(plain.leaks(rows, items)) and {d for d, _ in got} == {0, 1, 2, 4, 5, 6}


# odd rows


@pytest.mark.parametrize("which", ["odd", "nothing"])
def test_odd_rows_and_empty_tables(spark, request, which):
    docs = request.getfixturevalue(which)
    n = docs.count()
    items = spark.createDataFrame([(1, "twice the same row here"), (None, None)], "item_id long, text string")
    assert licenses.license_scan(docs).count() == 0
    assert personal.personal_data(docs).count() == n
    assert sum(r["n_tokens"] > 0 for r in rows_of(token_files.token_ids(docs))) == n
    near = rows_of(near_copies.near_copies(docs))
    assert len(near) == n
    mix = mixing.mixed(docs)
    assert mix.count() == n and set(docs.columns) <= set(mix.columns)
    scores = rows_of(class_lm.scored_texts(docs, F.lit(True)))
    assert len(scores) == n and all(np.isfinite(r["score"]) for r in scores)
    assert len(rows_of(fingerprints.fingerprinted(docs))) == n
    leaks = rows_of(contaminated(docs, items))
    assert [(r["doc_id"], r["item_id"]) for r in leaks] == ([(5, 1)] if n else [])
    assert contaminated(docs, items.limit(0)).count() == 0
    model = language.fit_languages(docs, F.lit(True))
    langs = rows_of(language.predict_languages(docs, model))
    assert len(langs) == n
    if n:
        by = {r["doc_id"]: r for r in near}
        assert by[1]["class_id"] == by[2]["class_id"] == 1 and by[5]["class_id"] == 5 and by[None]["class_id"] is None
        assert {r["lang_pred"] for r in langs if r["doc_id"] in (1, 2, 3)} == {"und"}


def test_docs_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = language.fit_languages(docs, F.lit(True))
    assert json.dumps(model.names) == "[]"
    assert rows_of(language.predict_languages(docs, model))[0]["lang_pred"] == "und"


def test_all_pairs_at_once():
    rng = np.random.default_rng(8)
    bags = [plain.Counter(rng.choice(40, rng.integers(1, 90)).tolist()) for _ in range(30)] + [plain.Counter({1: 50_000, 2: 1}), plain.Counter({1: 45_000})]
    flat = [sorted(b.items()) for b in bags]
    off = np.cumsum([0, *map(len, flat)])
    values, counts = (np.array([x[k] for b in flat for x in b]) for k in (0, 1))
    got = near_copies.all_similar(values.astype(np.uint64), counts, off, 0.5)
    want = [[plain.similarity(a, b) >= 0.5 for b in bags] for a in bags]
    assert (got == np.array(want)).all() and 32 < got.sum() < 32 * 32
