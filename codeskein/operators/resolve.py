"""Turning references by name into edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.functions import paths


def definitions_by_name(nodes: DataFrame) -> DataFrame:
    """(type, name, id): the last function and the last class of each name, by file then position."""
    symbols = nodes.filter(F.col("type").isin("function", "class"))
    last = F.max_by("id", F.struct(F.coalesce("file_id", F.lit("")), F.coalesce("ord", F.lit(-1)), "id"))
    return symbols.groupBy("type", "name").agg(last.alias("definition_id"))


def resolve(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """Edges for the references whose name is defined; the others drop out.

    Function placeholders look among functions only, class placeholders among classes only. The
    name table has one row per name, so a name that a third of all references use is a skewed key
    on one side only: adaptive execution splits that side.
    """
    wanted = references.select(
        "source_id",
        F.col("type").alias("edge_type"),
        "metadata",
        "ord",
        "owner",
        paths.placeholder_type(F.col("target_id")).alias("type"),
        paths.placeholder_name(F.col("target_id")).alias("name"),
    )
    return wanted.join(definitions_by_name(nodes), ["type", "name"]).select(
        "source_id",
        F.col("definition_id").alias("target_id"),
        F.col("edge_type").alias("type"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
        "ord",
        "owner",
    )


def resolved_edges(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """`resolve` with each (source, target, type) kept once."""
    return once_each(resolve(nodes, references))


def once_each(edges: DataFrame) -> DataFrame:
    firsts = edges.groupBy("source_id", "target_id", "type").agg(
        F.min("ord").alias("ord"), F.min("owner").alias("owner")
    )
    return firsts.select(
        "source_id", "target_id", "type", F.lit(None).cast("map<string,string>").alias("metadata"), "ord", "owner"
    )
