"""Text forms of the graph: DOT lines and the statistics page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeskein.operators import aggregates


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, line): header, one line per vertex, one per edge, footer, in order of (part, id)."""
    spark: SparkSession = nodes.sparkSession
    quoted = F.concat(F.lit('  "'), F.col("id"), F.lit('" [label="'), F.col("label"), F.lit('"];'))
    phantoms = aggregates.undefined_ids(nodes, edges).select(
        "id", F.concat(F.lit("unknown\\n"), F.col("id")).alias("label")
    )
    known = nodes.select("id", F.concat("type", F.lit("\\n"), "name").alias("label"))
    node_rows = known.unionByName(phantoms).select(F.lit(1).alias("part"), "id", quoted.alias("line"))
    arrow = F.concat(
        F.lit('  "'), "source_id", F.lit('" -> "'), "target_id", F.lit('" [label="'), "type", F.lit('"];')
    )
    edge_rows = edges.select(
        F.lit(2).alias("part"), F.concat_ws("\t", "source_id", "target_id", "type").alias("id"), arrow.alias("line")
    )
    # The lines around the body.
    head = ["digraph CodeGraph {", "  rankdir=LR;", "  node [shape=box];"]
    frame = [(0, str(i), line) for i, line in enumerate(head)] + [(3, "", "}")]
    rows = spark.createDataFrame(frame, "part int, id string, line string")
    return rows.unionByName(node_rows).unionByName(edge_rows)


def write_dot(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Write the DOT text as part files whose names sort in document order."""
    dot_lines(nodes, edges).orderBy("part", "id").select("line").write.mode("overwrite").text(folder)


def stats_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (text): totals, then nodes and edges per type in alphabetical order."""
    counts = aggregates.type_counts(nodes, edges)
    item = F.concat(F.lit("- "), F.col("type"), F.lit(": "), F.col("n").cast("string"), F.lit("\n"))

    def total(kind: str):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).cast("string")

    def section(kind: str):
        # At most one row per type, of which there are a handful.
        rows = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("type", item.alias("item")))))
        return F.array_join(F.transform(rows, lambda r: r["item"]), "")

    return counts.agg(
        F.concat(
            F.lit("# Graph Statistics\n\nTotal Nodes: "),
            total("node"),
            F.lit("\nTotal Edges: "),
            total("edge"),
            F.lit("\n\n## Node Types:\n"),
            section("node"),
            F.lit("\n## Edge Types:\n"),
            section("edge"),
        ).alias("text")
    )
