"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeskein.llm import op_oracles
from codeskein.llm._tables import Scratch
from codeskein.llm.chat import format_chats, read_chats
from codeskein.llm.chat_repair import damaged, repaired
from codeskein.llm.class_lm import scored_texts
from codeskein.llm.decontaminate import contaminated
from codeskein.llm.exact_copies import exact_copies
from codeskein.llm.fingerprints import fingerprinted
from codeskein.llm.language import fit_languages, predict_languages
from codeskein.llm.licenses import license_scan
from codeskein.llm.merkle import lower_cased, proved
from codeskein.llm.mixing import mixed, n_words
from codeskein.llm.near_copies import near_copies
from codeskein.llm.personal import KINDS, personal_data, span_text
from codeskein.llm.token_files import token_ids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Register a query under a name, with the DuckDB text for its rows if there is one."""

    def put(run):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return put


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


@query("op10_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = fit_languages(docs, fold != 1)
    got = predict_languages(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op5_near_copies", op_oracles.NEAR_COPIES)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


@query("op9_benchmark_leaks")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_mixture", op_oracles.MIXTURE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    sized = Scratch(spark, "mixture").keep(docs, "sizes")
    mix = mixed(sized, size=F.col("size"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op3_chats", op_oracles.CHATS)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_chats(format_chats(rows.unionByName(extra)))


@query("op7_class_scores")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7))
    got = scored_texts(table(spark, sf_dir, "documents"), fold != 2)
    return got.select("doc_id", (~F.col("training") & F.col("doc_id").isNotNull()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))


@query("op1_licenses")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@query("op2_personal_data")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text("base_spans"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


@query("op11_exact_copies", op_oracles.EXACT_COPIES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))


@query("op13_manifest", op_oracles.MERKLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    return proved(table(spark, sf_dir, "documents"), lower_cased(F.col("text")), tampered)


@query("op12_chat_repair", op_oracles.CHAT_REPAIR)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))
