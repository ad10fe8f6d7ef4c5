import hashlib
import zlib
from collections import Counter, defaultdict

import plain
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from codeskein.llm import chat
from codeskein.llm.mixing import mixed
from codeskein.llm.op_queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>[]|/\\sINTYSx ") | st.text())
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    got = chat.escape(pa.array([text])).to_pylist()[0]
    assert chat.unescape(got) == text
    assert not any(c in got for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=5), st.text(max_size=30)), min_size=1, max_size=6))
def test_assembled_texts_parse_back(turns):
    import numpy as np

    roles, texts = (chat.escape(pa.array([t[i] for t in turns], pa.string())) for i in (0, 1))
    formatted, first, last = chat.assemble(roles, texts, np.array([0, len(turns)]))
    whole = formatted.to_pylist()[0]
    assert chat.parse(whole) == turns
    assert [chat.unescape(whole[a:b]) for a, b in zip(first, last)] == [t for _, t in turns]


def digests(rows):
    groups = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups[c].append((role or "", text or ""))
    out = {}
    for c, turns in groups.items():
        said = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def read(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_chats_of_the_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    assert read(QUERIES["op3_chats"](spark, folder)) == digests([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def test_odd_conversations(spark):
    rows = [
        (None, 1, "user", "x"), (None, None, "assistant", "y"), (1, 0, None, None), (1, 1, "assistant", None), (2, 5, "assistant", "<|end|>" * 5000),
        (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 0, "assistant", "ü\U0001f600"), *[(4, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)],
    ]
    df = spark.createDataFrame(rows, TURNS).withColumns({"part": F.lit(1), "loss": F.lit(2), "formatted": F.lit("f")})
    formatted = chat.format_chats(df)
    assert formatted.where("conv_id = 4").count() == 3
    assert read(chat.read_chats(formatted)) == digests(rows)
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


def test_conversations_across_batches(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in range(7) for t in range(5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = read(chat.read_chats(chat.format_chats(spark.createDataFrame(rows, TURNS))))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == digests(rows)


# the pipeline


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The rows after each stage, each read from Parquet by the next."""
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        done = stage(spark, docs, folder)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert done.columns == names
        done.write.parquet(str(base / str(k)))
        docs = spark.read.parquet(str(base / str(k)))
        out.append(docs)
    return out


def ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def test_language_keeps_texts_with_letters(stages, documents):
    assert set(ids(stages[0])) == {d for d, t in documents if any(c.isalpha() for c in t)}


def test_one_document_of_each_group_stays(stages):
    before = sorted((r["doc_id"], r["text"]) for r in stages[0].collect())
    assert ids(stages[1]) == Counter(set(plain.near_classes(before).values()))


def test_leaking_documents_go(spark, stages, folder):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert set(ids(stages[2])) == {d for d, _ in before} - {d for d, _ in plain.leaks(before, items)}


def test_mixture_repeats_documents(stages):
    want = {r["doc_id"]: r["copies"] for r in mixed(stages[2]).select("doc_id", "copies").collect() if r["copies"]}
    assert ids(stages[3]) == Counter(want)


def test_files_hold_what_the_mixture_left(spark, stages, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    import numpy as np

    rows = sorted((r["doc_id"], r["text"]) for r in stages[3].collect())
    want, start = [], 0
    for d, t in rows:
        got = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(got), zlib.crc32(got.tobytes())))
        start += len(got)
    read = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert read(stages[4]) == want
    assert read(corpus_pipeline.run(spark, folder)) == want


def test_stages_on_odd_rows(spark, odd, nothing, folder):
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns
            stage(spark, docs, folder).count()
    assert ids(corpus_pipeline.one_of_each(spark, odd, folder))[5] == 1
