"""Counts, degrees and PageRank."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.session import cut, release


def undefined_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that edges mention and no node has: one aggregation, combined before its shuffle."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"), F.lit(False).alias("defined"))
    both = ends.unionByName(nodes.select("id", F.lit(True).alias("defined")))
    return both.groupBy("id").agg(F.bool_or("defined").alias("defined")).filter("NOT defined").select("id")


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n): nodes and edges per type; endpoints without a node count as `unknown`."""
    phantoms = undefined_ids(nodes, edges).select(F.lit("unknown").alias("type"))
    node_rows = nodes.select("type").unionByName(phantoms).select(F.lit("node").alias("kind"), "type")
    edge_rows = edges.select(F.lit("edge").alias("kind"), "type")
    return node_rows.unionByName(edge_rows).groupBy("kind", "type").agg(F.count("*").alias("n"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: total_nodes and total_edges."""
    counted = type_counts(nodes, edges)
    return counted.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "node", F.col("n"))), F.lit(0)).alias("total_nodes"),
        F.coalesce(F.sum(F.when(F.col("kind") == "edge", F.col("n"))), F.lit(0)).alias("total_edges"),
    )


def _links(edges: DataFrame) -> DataFrame:
    """The simple graph: each ordered pair once, whatever the number of edge types between."""
    return edges.select("source_id", "target_id").distinct()


def complexity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, complexity): half the number of links at a node, a loop counting twice, 0.0 for none."""
    ends = _links(edges).select(F.explode(F.array("source_id", "target_id")).alias("id"))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(degree, "id", "left").select(
        "id", (F.coalesce("degree", F.lit(0)) / F.lit(2.0)).alias("complexity")
    )


def complexity_of(edges: DataFrame, node_id: str) -> DataFrame:
    """One row for one id, from its own edges only."""
    touching = edges.filter((F.col("source_id") == node_id) | (F.col("target_id") == node_id))
    hits = (F.col("source_id") == node_id).cast("int") + (F.col("target_id") == node_id).cast("int")
    return _links(touching).agg((F.coalesce(F.sum(hits), F.lit(0)) / F.lit(2.0)).alias("complexity")).select(
        F.lit(node_id).alias("id"), "complexity"
    )


class NotConverged(RuntimeError):
    """PageRank still moved after the last allowed iteration."""


def pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    alpha: float = 0.85,
    max_iterations: int = 100,
    tolerance: float | None = 1e-6,
    links_per_slot: int = 200_000,
) -> DataFrame:
    """(id, rank) over the simple graph, the mass of dangling nodes spread evenly.

    Stops once the summed change falls below `tolerance` per node and raises if that never
    happens; `tolerance=None` runs exactly `max_iterations`.

    The links are laid out once by (source, slot): a source with many links is split into slots
    of about `links_per_slot`, and its rank is sent to each of them, so no partition grows with
    the out-degree of a hub. Contributions are summed before the shuffle, which does the same for
    in-degree. Per iteration only ranks and partial sums move.
    """
    spark = edges.sparkSession
    pairs = cut(_links(edges), "pairs")
    out_degree = pairs.groupBy("source_id").agg(F.count("*").alias("degree"))
    ends = pairs.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    vertices = nodes.select("id").unionByName(ends).distinct()
    slots = F.ceil(F.col("degree") / F.lit(links_per_slot)).cast("int")
    written = cut(
        vertices.join(out_degree, vertices["id"] == out_degree["source_id"], "left").select(
            "id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce(slots, F.lit(0)).alias("slots")
        ),
        "vertices",
    )
    ranks = written
    n = ranks.count()
    if n == 0:
        return ranks.select("id", F.lit(0.0).alias("rank"))
    ranks = ranks.withColumn("rank", F.lit(1.0 / n))

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = ranks.filter("slots > 1").select(F.col("id").alias("source_id"), "slots")
    slot = F.pmod(F.xxhash64("target_id"), F.coalesce("slots", F.lit(1))).cast("int")
    links = (
        pairs.join(split, "source_id", "left")
        .select("source_id", "target_id", slot.alias("slot"))
        .repartition(width, "source_id", "slot")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        dangling = ranks.filter("degree = 0").count() / n
        change = None
        for i in range(max_iterations):
            senders = ranks.filter("slots > 0").select(
                F.col("id").alias("source_id"),
                F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"),
                (F.col("rank") / F.col("degree")).alias("share"),
            )
            received = links.join(senders, ["source_id", "slot"]).select(
                F.col("target_id").alias("id"),
                F.col("share").alias("part"),
                F.lit(None).cast("long").alias("degree"),
                F.lit(None).cast("int").alias("slots"),
                F.lit(None).cast("double").alias("before"),
            )
            # Every vertex also sends itself its own row, which spares a join to bring it back.
            own = ranks.select("id", F.lit(0.0).alias("part"), "degree", "slots", F.col("rank").alias("before"))
            summed = received.unionByName(own).groupBy("id").agg(
                F.sum("part").alias("part"),
                F.max("degree").alias("degree"),
                F.max("slots").alias("slots"),
                F.max("before").alias("before"),
            )
            rank = F.lit((1.0 - alpha) / n + alpha * dangling / n) + F.lit(alpha) * F.col("part")
            before, written = written, cut(summed.select("id", "degree", "slots", "before", rank.alias("rank")), "ranks")
            ranks = written
            if i:  # the vertices at the beginning are read through the links
                release(before)
            if tolerance is None and i == max_iterations - 1:
                break
            change, dangling = ranks.agg(
                F.sum(F.abs(F.col("rank") - F.col("before"))),
                F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("rank"))), F.lit(0.0)),
            ).first()
            if tolerance is not None and change < n * tolerance:
                break
        else:
            if tolerance is not None:
                raise NotConverged(f"change {change} after {max_iterations} iterations")
    finally:
        links.unpersist()
        release(pairs)
    return ranks.select("id", "rank")


def central_nodes(nodes: DataFrame, edges: DataFrame, top_k: int = 10, **options) -> DataFrame:
    """The `top_k` ids of highest rank that are nodes, joined with them.

    The cut comes before the join, as in the reproduced behaviour: an undefined endpoint among
    the first `top_k` leaves a gap.
    """
    best = pagerank(nodes, edges, **options).orderBy(F.desc("rank"), "id").limit(top_k)
    return nodes.join(best.withColumnRenamed("rank", "score"), "id")
