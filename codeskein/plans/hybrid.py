"""The hybrid query: nearest documents, their graph neighbourhood, one ranking, one context."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.operators import ranking, traversal
from codeskein.session import cut

# `is_neighbour`, `seed_rank`, `depth`: equal scores keep hits before neighbours and both in the
# order in which they were found.
FINAL_ORDER = ("is_neighbour", "seed_rank", "depth", "id")


@dataclass
class QueryResult:
    """Ranked nodes with a `score`, the order of their rank, and a few numbers about the run."""

    nodes: DataFrame
    order: list = field(default_factory=list)
    metadata: dict = field(default_factory=dict)
    max_length: int = 4000

    def context_frame(self) -> DataFrame:
        return ranking.pack_context(self.nodes, *self.order, max_length=self.max_length)

    @property
    def context(self) -> str:
        return self.context_frame().first()["context"]

    def scores(self) -> DataFrame:
        return self.nodes.select("id", "score")


def hits_with_nodes(hits: DataFrame, nodes: traversal.Rows, k: int) -> DataFrame:
    """(rank, id, score): hits that are nodes, renumbered in the same order.

    An inner join, for ids are unique: of a semi join only the right side, here the large one, could be broadcast.
    """
    known = traversal.nodes_near(nodes, hits).select("id").join(hits, "id")
    scored = known.select("id", F.col("rank").alias("_hit"), ranking.similarity(F.col("distance")).alias("score"))
    return ranking.ranked(scored, k, F.col("_hit")).select("rank", "id", "score")


def rank_hits(
    nodes: traversal.Rows,
    edges: traversal.Rows,
    hits: DataFrame,
    max_results: int = 10,
    expand: bool = True,
    depth: int = 1,
    node_types: tuple[str, ...] = (),
    filter_neighbours: bool = False,
) -> DataFrame:
    """Nodes with (score, is_neighbour, seed_rank, depth) and their final `rank`.

    The hits, at most `max_results` rows, are written once so that the search behind them runs
    once. `node_types` restricts neighbours only when `filter_neighbours` asks for it.
    """
    hits = cut(hits_with_nodes(hits, nodes, max_results), "hits")
    found = hits.select(
        "id", "score", F.lit(False).alias("is_neighbour"), F.col("rank").alias("seed_rank"), F.lit(0).alias("depth")
    )
    if expand:
        near = traversal.expand_hits(edges, hits, depth)
        found = found.unionByName(near.select("id", "score", F.lit(True).alias("is_neighbour"), "seed_rank", "depth"))
        found = cut(found, "candidates")
    # One read of the nodes both drops ids without a node and fetches the fields.
    fetched = traversal.nodes_near(nodes, found).join(found, "id")
    if expand and filter_neighbours and node_types:
        fetched = fetched.filter(~F.col("is_neighbour") | F.col("type").isin(*node_types))
    return ranking.ranked(fetched, max_results, F.desc("score"), *[F.col(c) for c in FINAL_ORDER])
