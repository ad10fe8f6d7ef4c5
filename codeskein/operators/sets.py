"""Upserts and removals as whole-table set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.schema import owner_of_node


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. The maximum is combined before the shuffle: hot keys stay small."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`new` replaces the rows of `old` with the same key. `new` holds each key once."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def without_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop nodes and every edge that starts or ends at one. Unknown ids change nothing."""
    gone = ids.select("id").distinct()
    kept_nodes = nodes.join(gone, "id", "left_anti")
    kept_edges = edges.join(gone, edges["source_id"] == gone["id"], "left_anti")
    kept_edges = kept_edges.join(gone, kept_edges["target_id"] == gone["id"], "left_anti")
    return kept_nodes, kept_edges


def nodes_of_files(nodes: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Ids of the files themselves and of all that belongs to them."""
    wanted = file_ids.select(F.col("file_id").alias("_file")).distinct()
    return (
        nodes.select("id", owner_of_node().alias("_owner"))
        .join(wanted, F.col("_owner") == F.col("_file"), "left_semi")
        .select("id")
    )


def without_files(nodes: DataFrame, edges: DataFrame, file_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop files, their symbols, and every edge at one of them."""
    return without_nodes(nodes, edges, nodes_of_files(nodes, file_ids))


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node: the check that stands in for a foreign key."""
    ids = nodes.select("id")
    ends = edges.select("source_id", "target_id", "type", F.explode(F.array("source_id", "target_id")).alias("id"))
    return ends.join(ids, "id", "left_anti").select("source_id", "target_id", "type").distinct()
