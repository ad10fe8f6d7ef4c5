"""The graph as stored tables: nodes, edges, open references, resolved edges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeskein.operators import aggregates, lookup, resolve
from codeskein.schema import EDGES, NODES, conform
from codeskein.session import cut, release, remove, work_folder
from codeskein.versions import Layout, StoredRows, VersionedTables

_TABLES = ("nodes", "edges", "references")
_EDGE_KEY = ("source_id", "target_id", "type")
_ENDS = Layout(EDGES, _EDGE_KEY, ("source_id", "target_id"), by_type=True)
LAYOUTS = {
    "nodes": Layout(NODES, ("id",), ("id", "file_id"), by_type=True),
    "edges": _ENDS,
    "references": Layout(EDGES, ("owner",), ("owner",), ties=("source_id", "target_id")),
    "resolved": _ENDS,
}


class GraphStore:
    """Nodes and edges in versioned parquet tables, below `path` or, without one, in the work folder of the session.

    Nodes are found by id and by file, edges by either end, without reading other files than those that may hold them.
    Every method that changes the graph is one commit over all its tables, and writes only what changes.

    `references` are the calls and base classes that name a symbol; `resolve()` turns them into edges, which live
    apart since they depend on all files at once.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, **options: int):
        self.spark = spark
        self.path = str(path).rstrip("/") if path else None
        self.tables = VersionedTables(spark, self.path or f"{work_folder(spark)}/graph-{uuid.uuid4().hex}", LAYOUTS, **options)

    # --- reading ---

    @property
    def node_rows(self) -> StoredRows:
        """The nodes for lookups by id or file."""
        return self.tables.rows("nodes")

    @property
    def edge_rows(self) -> StoredRows:
        """The edges, resolved ones included, for lookups by either end."""
        return self.tables.rows("edges", "resolved")

    @property
    def nodes(self) -> DataFrame:
        return self.node_rows.all()

    @property
    def references(self) -> DataFrame:
        return self.tables.rows("references").all()

    @property
    def resolved(self) -> DataFrame:
        return self.tables.rows("resolved").all()

    @property
    def edges(self) -> DataFrame:
        return self.edge_rows.all()

    def get_node(self, node_id: str) -> DataFrame:
        return self.node_rows.near("id", node_id)

    def get_nodes_by_type(self, node_type: str) -> DataFrame:
        return lookup.nodes_of_type(self.nodes, node_type)

    def get_nodes_by_name(self, name: str, exact: bool = True) -> DataFrame:
        return lookup.nodes_by_name(self.nodes, name, exact)

    def get_edges_from(self, node_id: str, edge_type: str | None = None) -> DataFrame:
        return lookup.edges_from(self.edge_rows.near("source_id", node_id), node_id, edge_type)

    def get_edges_to(self, node_id: str, edge_type: str | None = None) -> DataFrame:
        return lookup.edges_to(self.edge_rows.near("target_id", node_id), node_id, edge_type)

    def node_count(self) -> int:
        """Nodes, endpoints without a node included."""
        return aggregates.totals(self.nodes, self.edges).first()["total_nodes"]

    def edge_count(self) -> int:
        return self.edges.count()

    def get_stats(self) -> dict:
        """Totals and counts per type; a handful of rows."""
        rows = aggregates.type_counts(self.nodes, self.edges).collect()
        nodes = {r["type"]: r["n"] for r in rows if r["kind"] == "node"}
        edges = {r["type"]: r["n"] for r in rows if r["kind"] == "edge"}
        return {
            "total_nodes": sum(nodes.values()),
            "total_edges": sum(edges.values()),
            "node_types": dict(sorted(nodes.items())),
            "edge_types": dict(sorted(edges.items())),
        }

    # --- changing ---

    def replace_all(self, new: dict[str, DataFrame], state: dict[str, str] | None = None) -> None:
        """Make the new `nodes`, `edges` and `references` the whole graph, nothing resolved yet."""
        rows = {name: conform(new[name], LAYOUTS[name].schema) for name in _TABLES}
        self.tables.commit(rows, replaced=LAYOUTS, facts=state)

    def add_nodes(self, nodes: DataFrame) -> None:
        """Insert or replace by id; `nodes` holds each id once."""
        self._upsert("nodes", nodes)

    def add_node(self, **fields) -> None:
        """Insert or replace one node given by its fields."""
        row = {f.name: fields.get(f.name) for f in NODES.fields}
        self.add_nodes(self.spark.createDataFrame([row], NODES))

    def add_edge(self, source_id: str, target_id: str, type: str, metadata: dict | None = None) -> None:
        row = (source_id, target_id, type, metadata, 0, source_id)
        self.add_edges(self.spark.createDataFrame([row], EDGES))

    def add_edges(self, edges: DataFrame) -> None:
        """Insert or replace by (source, target, type)."""
        self._upsert("edges", edges)

    def _upsert(self, name: str, rows: DataFrame) -> None:
        new = cut(conform(rows, LAYOUTS[name].schema), name)
        self.tables.commit({name: new}, {name: new})
        release(new)

    def remove_nodes(self, ids: DataFrame) -> None:
        """Remove nodes with all their edges. Unknown ids change nothing."""
        gone = cut(ids.select("id").distinct(), "gone")
        self.tables.commit(dead=self._dead(gone))
        release(gone)

    def remove_node(self, node_id: str) -> None:
        self.remove_nodes(self.spark.createDataFrame([(node_id,)], "id string"))

    def remove_files(self, files: DataFrame) -> None:
        """Remove files (file_id) with their symbols, edges and references."""
        self.replace_files(files, {})

    def remove_file_nodes(self, path: str) -> None:
        self.remove_files(self.spark.createDataFrame([(f"file:{path}",)], "file_id string"))

    def replace_files(self, files: DataFrame, new: dict[str, DataFrame], state: dict[str, str] | None = None) -> None:
        """Remove files (file_id) and put the new `nodes`, `edges`, `references` and facts, in one commit."""
        files = cut(files.select(F.col("file_id").alias("id")).distinct(), "files")
        theirs = self.node_rows.near("file_id", files).withColumnRenamed("id", "node")
        theirs = theirs.join(files, theirs["file_id"] == files["id"], "left_semi").select(F.col("node").alias("id"))
        gone = cut(theirs.unionByName(files).distinct(), "gone")
        dead = self._dead(gone) | {"references": files.select(F.col("id").alias("owner"))}
        self.tables.commit({name: conform(rows, LAYOUTS[name].schema) for name, rows in new.items()}, dead, facts=state)
        release(files, gone)

    def _dead(self, gone: DataFrame) -> dict[str, DataFrame]:
        """Keys of nodes that go and of all edges at them."""

        def at(name: str) -> DataFrame:
            rows = self.tables.rows(name)
            ends = [rows.near(end, gone).join(gone, F.col(end) == F.col("id"), "left_semi").select(*_EDGE_KEY) for end in ("source_id", "target_id")]
            return ends[0].unionByName(ends[1])

        return {"nodes": gone, "edges": at("edges"), "resolved": at("resolved")}

    def resolve(self) -> int:
        """Recompute the edges behind references; the number of references that were resolved."""
        found = cut(resolve.resolve(self.nodes, self.references), "found")
        self.tables.commit({"resolved": conform(resolve.once_each(found), EDGES)}, replaced=["resolved"])
        count = found.count()
        release(found)
        return count

    # --- small facts ---

    def get_state(self, key: str) -> str | None:
        return self.tables.facts().get(key)

    def set_state(self, key: str, value: str) -> None:
        self.tables.commit(facts={key: value})

    def close(self) -> None:
        """A store without a path is deleted; nothing else is held open."""
        if self.path is None:
            remove(self.spark, self.tables.path)
