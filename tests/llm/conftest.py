import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("no table folder")
    return FOLDER


@pytest.fixture(scope="session")
def documents(spark, folder):
    """All rows of the small table of documents, as (doc_id, text)."""
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r[0], r[1]) for r in rows)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, "a text without a number of its own", "en", "s", 1),
    (1, None, "en", "s", 0),
    (2, "", None, None, 0),
    (3, " \n\t ", "en", None, 4),
    (4, "one", "en", "t", 3),
    (5, "twice the same row here", "en", "t", 23),
    (5, "twice the same row here", "en", "t", 23),
    (6, "Ünïcode 日本語 😀 text with more than five words", "de", "u", 40),
    (7, "x" * 200_000, "en", "u", 200_000),
    (8, "many words " * 30_000, "fr", "u", 330_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ("score", "size", "spans", "copies", "node", "bands", "range_no", "row", "part", "_rows", "start", "training_", "ahead", "target")
    return spark.createDataFrame(ODD, DOCS).withColumns({n: F.lit(7) for n in names})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
