"""Breadth-first traversal as a loop of frontier joins.

Each hop joins the frontier with the edge table, and one aggregation both removes repeats and
drops what earlier levels hold. A hop is written to the shared folder before the next one starts,
so plans stay short, lost executors cost one hop at most, and the planner sees the frontier's
true size: a small one is broadcast against the edges, a large one is joined by shuffle, where
adaptive execution splits the partitions of hub nodes. The aggregation combines before its
shuffle, and a hub's neighbours are spread by their own ids.

Edges and nodes may be DataFrames or `StoredRows` of a store; of the latter a hop reads only the files that may hold
what its frontier touches, as long as the frontier is short.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.operators import lookup
from codeskein.session import cut, release
from codeskein.versions import StoredRows

Rows = DataFrame | StoredRows


def _all(rows: Rows) -> DataFrame:
    return rows.all() if isinstance(rows, StoredRows) else rows


def neighbours(
    edges: Rows, frontier: DataFrame | str, direction: str, carry: Sequence[str] = ()
) -> DataFrame:
    """Ends of the edges that leave (`out`), enter (`in`) or touch (`both`) the frontier's ids.

    A frontier of one id is a filter, which reaches the scan.
    """

    def hop(near: str, far: str) -> DataFrame:
        rows = edges.near(near, frontier) if isinstance(edges, StoredRows) else edges
        if isinstance(frontier, str):
            return rows.filter(F.col(near) == frontier).select(F.col(far).alias("id"))
        ends = rows.select(F.col(near).alias("id"), F.col(far).alias("next_id"))
        return frontier.join(ends, "id").select(*carry, F.col("next_id").alias("id"))

    if direction == "out":
        return hop("source_id", "target_id")
    if direction == "in":
        return hop("target_id", "source_id")
    return hop("source_id", "target_id").unionByName(hop("target_id", "source_id"))


def _new_only(reached: DataFrame, known: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Distinct keys of `reached` that no known level holds.

    Tagging and grouping does in one shuffle what a distinct and an anti-join would do in two, and
    keeps the optimizer from moving the anti-join below the edge scan.
    """
    tagged = [reached.select(*keys, F.lit(False).alias("_known"))]
    tagged += [level.select(*keys, F.lit(True).alias("_known")) for level in known]
    merged = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(F.bool_or("_known").alias("_known"))
    return merged.filter(~F.col("_known")).select(*keys)


def bfs(
    edges: Rows,
    seeds: DataFrame | str,
    max_depth: int | None,
    direction: str = "both",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Ids reachable from `seeds` with their least distance (1 and up), seeds themselves excluded.

    `seeds` is a table of ids or a single id. `carry` names columns of `seeds` that keep several searches apart. `max_depth=None` runs until
    a hop finds nothing new. A bounded search leaves its last hop lazy, so depth 1 starts no job.
    """
    keys = [*carry, "id"]
    if isinstance(seeds, str):
        frontier = seeds
        levels = [edges.sparkSession.range(0, 1, 1, 1).select(F.lit(seeds).alias("id"))]
    else:
        frontier = seeds.select(*keys)
        levels = [frontier]
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = neighbours(edges, frontier, direction, carry)
        # Undirected neighbours of a level lie in it, right before it or right after it, so two
        # levels are enough there; a directed edge may point back to any level.
        known = levels[-2:] if direction == "both" else levels
        fresh = _new_only(reached, known, keys)
        if max_depth is None or depth < max_depth:
            fresh = cut(fresh, "hop")
            if fresh.isEmpty():
                break
        levels.append(fresh)
        frontier = fresh
    found = [level.withColumn("depth", F.lit(i)) for i, level in enumerate(levels)]
    if len(found) == 1:
        return found[0].filter(F.lit(False))
    return reduce(DataFrame.unionByName, found[1:])


def _of_types(edges: Rows, types: Iterable[str] | None) -> Rows:
    types = list(types or ())
    if isinstance(edges, StoredRows):
        return edges.of_types(types) if types else edges
    return edges.filter(F.col("type").isin(*types)) if types else edges


def _nodes_of(nodes: Rows, found: DataFrame) -> DataFrame:
    """The nodes that were found, with the columns of `found`."""
    if isinstance(nodes, StoredRows):
        found = cut(found, "found")
    return nodes_near(nodes, found).join(found, "id")


def nodes_near(nodes: Rows, ids: DataFrame) -> DataFrame:
    """Nodes among which those with the ids are, still to be joined."""
    return nodes.near("id", ids) if isinstance(nodes, StoredRows) else nodes


def related(
    nodes: Rows,
    edges: Rows,
    node_id: str,
    max_depth: int = 2,
    edge_types: Iterable[str] | None = None,
) -> DataFrame:
    """Nodes within `max_depth` steps, edges taken both ways."""
    found = bfs(_of_types(edges, edge_types), node_id, max_depth)
    return _nodes_of(nodes, found)


def callers(nodes: Rows, edges: Rows, function_id: str, max_depth: int = 3) -> DataFrame:
    """Functions that reach this one over calls; distances up to `max_depth + 1`."""
    found = bfs(_of_types(edges, ["calls"]), function_id, max_depth + 1, "in")
    return _nodes_of(nodes, found)


def callees(nodes: Rows, edges: Rows, function_id: str, max_depth: int = 3) -> DataFrame:
    """Functions this one reaches over calls; distances up to `max_depth + 1`."""
    found = bfs(_of_types(edges, ["calls"]), function_id, max_depth + 1, "out")
    return _nodes_of(nodes, found)


def inheritance_chain(nodes: Rows, edges: Rows, class_id: str) -> DataFrame:
    """First parent, its first parent and so on; `depth` is the place in the chain.

    Only the first edge of a class counts (least `ord`, then target). A cycle or an undefined
    parent ends the chain. The table of first parents is made once; its jumps double in length from round to
    round, so a chain of n classes takes about log2(n) rounds.
    """
    first = F.min_by("target_id", F.struct("ord", "target_id")).alias("id")
    jump = _all(_of_types(edges, ["inherits"])).groupBy("source_id").agg(first)
    jump = cut(_all(nodes).select("id").join(jump, "id").select(F.col("source_id").alias("child"), "id"), "parents")
    found = edges.sparkSession.range(0, 1, 1, 1).select(F.lit(class_id).alias("id"), F.lit(0).alias("depth"))
    length, known = 1, 1
    while True:
        further = found.join(jump, found["id"] == jump["child"]).select(jump["id"], (F.col("depth") + length).alias("depth"))
        before, found = found, cut(found.unionByName(further).groupBy("id").agg(F.min("depth").alias("depth")), "chain")
        release(before)
        count = found.count()
        if count == known:
            release(jump)
            break
        known, length = count, 2 * length
        near = jump.withColumnRenamed("id", "middle")
        far = jump.select(F.col("child").alias("middle"), "id")
        before, jump = jump, cut(near.join(far, "middle").select("child", "id"), "jumps")
        release(before)
    return _nodes_of(nodes, found.filter("depth > 0"))


def subclasses(nodes: Rows, edges: Rows, class_id: str, recursive: bool = True) -> DataFrame:
    """All classes below this one, or only the direct ones."""
    kinds = _of_types(edges, ["inherits"])
    # a walk to the end asks for most of the hierarchy: its edges are read at once, not file by file in every hop
    found = bfs(_all(kinds), class_id, None, "in") if recursive else bfs(kinds, class_id, 1, "in")
    return _nodes_of(nodes, found)


def references(nodes: Rows, edges: Rows, symbol_id: str, max_results: int = 20) -> DataFrame:
    """Callers of a function or subclasses of a class, the nearest first, score 0.8."""
    known = nodes.near("id", symbol_id) if isinstance(nodes, StoredRows) else nodes
    row = lookup.node(known, symbol_id).select("type").first()
    kind = row["type"] if row else None
    if kind == "function":
        found = callers(nodes, edges, symbol_id)
    elif kind == "class":
        found = subclasses(nodes, edges, symbol_id)
    else:
        found = known.filter(F.lit(False)).withColumn("depth", F.lit(0))
    return found.withColumn("score", F.lit(0.8)).orderBy("depth", "id").limit(max_results)


def expand_hits(
    edges: Rows, hits: DataFrame, max_depth: int = 1, seeds: int = 5, default_score: float = 0.5
) -> DataFrame:
    """Neighbourhood of the first `seeds` hits: (id, seed_rank, depth, score).

    A neighbour belongs to the first hit, in rank order, that reaches it, and takes that hit's
    score halved once per step. Hits themselves are left out.
    """
    starts = hits.filter(F.col("rank") <= seeds).select(F.col("rank").alias("seed_rank"), "id")
    reached = bfs(edges, starts, max_depth, carry=["seed_rank"])
    # both numbers in one, as the least struct would be found by sorting all that was reached
    owner = F.min(F.col("seed_rank").cast("long") * F.lit(1 << 32) + F.col("depth")).alias("first")
    first = reached.groupBy("id").agg(owner).select(
        "id",
        F.expr("first div 4294967296").cast(hits.schema["rank"].dataType).alias("seed_rank"),
        (F.col("first") % F.lit(1 << 32)).cast("int").alias("depth"),
    )
    base = hits.select(F.col("rank").alias("seed_rank"), F.col("score").alias("seed_score"))
    return (
        first.join(hits.select("id"), "id", "left_anti")
        .join(base, "seed_rank")
        .select(
            "id",
            "seed_rank",
            "depth",
            (F.coalesce("seed_score", F.lit(default_score)) * F.pow(F.lit(0.5), F.col("depth"))).alias("score"),
        )
    )
