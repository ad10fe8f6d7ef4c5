import numpy as np
import pyarrow as pa
from plain import words
from pyspark.sql import functions as F

from codeskein.llm._tables import id_bounds, range_of
from codeskein.llm._words import multisets, pieces, shingles, word_hashes, word_spans, buffers

TEXTS = ["", " ", "a", " a b\n\nc ", "ä ö\tü\x0bx", "long" * 50 + " z", "a b c d e f a b c d e", " no cut here"]


def test_words_are_those_of_the_pattern():
    data, off = buffers(pa.array(TEXTS, pa.large_string()))
    starts, ends, n = word_spans(data, off)
    got = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert [got[a:b] for a, b in zip(n[:-1], n[1:])] == [words(t) for t in TEXTS]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    hashes, off = word_hashes(pa.array(["alpha beta", "beta", "x alpha", "alphabeta"], pa.large_string()))
    assert hashes[1] == hashes[2] and hashes[0] == hashes[4] and len(set(hashes.tolist())) == 4


def test_shingles_and_counts():
    hashes, off = word_hashes(pa.array(["a b c d e f", "a b c d e", "a b", "", "a b c d e a b c d e"], pa.large_string()))
    values, soff = shingles(hashes, off)
    assert np.diff(soff).tolist() == [2, 1, 1, 0, 6]
    assert values[0] == values[2] == values[4] == values[9]
    distinct, counts, doff = multisets(values, soff)
    assert counts[doff[4] :].sum() == 6 and np.diff(doff).tolist() == [2, 1, 1, 0, 5]


def test_pieces_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["ab" * 40, None, "c", "d" * 500, ""]})
    got = list(pieces(iter([batch]), limit=100))
    assert len(got) == 2 and sum((p.column(0).to_pylist() for p in got), []) == batch.column(0).to_pylist()


def test_ranges(spark):
    df = spark.range(1000).withColumn("id", F.when(F.col("id") < 3, None).otherwise(F.col("id")))
    bounds = id_bounds(df, "id", 37)
    rows = df.select("id", range_of(F.col("id"), bounds).alias("r")).collect()
    for value, r in rows:
        assert r == (0 if value is None else sum(b <= value for b in bounds))
    assert id_bounds(df.limit(0), "id", 5) == []
