"""A training corpus from `documents`: language, near copies, benchmark leaks, mixture, token files.

Every stage takes the rows that its predecessor kept, written as Parquet and read again, and all but the last return
the columns of `documents`. A doc_id names one document: decisions on it hold for all rows that carry it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeskein.llm._tables import Scratch
from codeskein.llm.decontaminate import contaminated
from codeskein.llm.language import UNDETERMINED, fit_languages, predict_languages
from codeskein.llm.mixing import emitted, mixed
from codeskein.llm.near_copies import near_copies
from codeskein.llm.token_files import token_ids

LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with letters whose likeliest language has at least half of the probability; the labelled rows teach."""
    model = fit_languages(docs, F.lit(True))
    own = set(docs.columns) & {"lang_pred", "score"}
    found = predict_languages(docs.select("text", F.struct(*docs.columns).alias("row")) if own else docs, model)
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select("row.*" if own else "*").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; of repeated rows one."""
    found = near_copies(docs.select("doc_id", "text"))
    is_head = F.col("doc_id").eqNullSafe(F.col("class_id"))
    ids = found.groupBy(F.col("doc_id").alias("_id")).agg(F.bool_or(is_head).alias("_stays"), F.count("*").alias("_rows"))
    # far fewer ids go, or stand on several rows, than stay on one
    marked = Scratch(spark, "marked").keep(ids.where("NOT _stays OR _rows > 1"), "ids")
    joined = docs.join(marked, docs["doc_id"].eqNullSafe(marked["_id"]), "left")
    columns = [docs[c] for c in docs.columns]
    single = joined.where(marked["_rows"].isNull()).select(*columns)
    if marked.where("_stays").isEmpty():
        return single
    return single.unionByName(joined.where(marked["_stays"]).select(*columns).dropDuplicates(["doc_id", "text"]))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_id")).distinct()
    leaks = Scratch(spark, "leaks").keep(leaks, "leaks")
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["_id"]), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its own draw say."""
    own = set(docs.columns) & {"size", "source_size", "target", "copies"}
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row")) if own else docs
    return emitted(mixed(rows)).select("row.*" if own else "*").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents: doc_id, start, n_tokens, ids_crc32."""
    return token_ids(docs)


STAGES = [
    ("language", known_language),
    ("near copies", one_of_each),
    ("benchmark leaks", without_leaks),
    ("mixture", mixture),
    ("token files", tokens),
]

#: SQL can't express language models and tokenizers; tests/llm compares the stages with plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, f"stage-{k}")
            if k:
                scratch.drop(f"stage-{k - 1}")
    return docs
