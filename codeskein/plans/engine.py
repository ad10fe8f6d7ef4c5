"""Questions to a stored graph."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.functions import text
from codeskein.operators import aggregates, lookup, traversal
from codeskein.plans.hybrid import QueryResult, rank_hits
from codeskein.search import VectorStore
from codeskein.session import cut
from codeskein.store import GraphStore


class GraphTraversal:
    """The graph operators bound to one store."""

    def __init__(self, store: GraphStore):
        self.store = store

    def get_related_symbols(
        self, node_id: str, max_depth: int = 2, edge_types: Iterable[str] | None = None
    ) -> DataFrame:
        return traversal.related(self.store.node_rows, self.store.edge_rows, node_id, max_depth, edge_types)

    def find_callers(self, function_id: str, max_depth: int = 3) -> DataFrame:
        return traversal.callers(self.store.node_rows, self.store.edge_rows, function_id, max_depth)

    def find_callees(self, function_id: str, max_depth: int = 3) -> DataFrame:
        return traversal.callees(self.store.node_rows, self.store.edge_rows, function_id, max_depth)

    def find_inheritance_chain(self, class_id: str) -> DataFrame:
        return traversal.inheritance_chain(self.store.node_rows, self.store.edge_rows, class_id)

    def find_subclasses(self, class_id: str, recursive: bool = True) -> DataFrame:
        return traversal.subclasses(self.store.node_rows, self.store.edge_rows, class_id, recursive)

    def get_file_symbols(self, file_id: str) -> DataFrame:
        edges = self.store.edge_rows.near("source_id", file_id)
        return lookup.file_symbols(self.store.node_rows.near("id", edges.select(F.col("target_id").alias("id"))), edges, file_id)

    def find_dependencies(self, file_id: str) -> DataFrame:
        return lookup.dependencies(self.store.nodes, self.store.edges, file_id)

    def find_dependents(self, module_name: str) -> DataFrame:
        return lookup.dependents(self.store.nodes, module_name)

    def get_complexity_score(self, node_id: str) -> float:
        rows = self.store.edge_rows
        ends = rows.near("source_id", node_id).unionByName(rows.near("target_id", node_id).filter(F.col("source_id") != node_id))
        return aggregates.complexity_of(ends, node_id).first()["complexity"]

    def find_central_nodes(self, top_k: int = 10) -> DataFrame:
        return aggregates.central_nodes(self.store.nodes, self.store.edges, top_k)

    def search_nodes(
        self, predicate, node_types: Iterable[str] = (), columns: Iterable[str] | None = None, vectorized: bool = False
    ) -> DataFrame:
        return lookup.search_nodes(self.store.nodes, predicate, node_types, columns, vectorized)


class QueryEngine:
    """Symbol lookup, references, file summaries and the hybrid query over one store."""

    def __init__(self, store: GraphStore, vector_store: VectorStore | None = None, vector_path: str | None = None):
        self.store = store
        self.traversal = GraphTraversal(store)
        self.vectors = vector_store or VectorStore(store.spark, vector_path)

    def index_vectors(self) -> int:
        """Make the collection hold one document per node; only nodes that came, went or changed are written."""
        documents = self.store.nodes.select("id", text.document().alias("document"), "type", "name")
        return self.vectors.renew(documents.filter(F.col("document") != ""))

    def query(
        self,
        query_text: str,
        node_types: Iterable[str] | None = None,
        max_results: int = 10,
        expand_graph: bool = True,
        graph_depth: int = 1,
        filter_neighbours: bool = False,
    ) -> QueryResult:
        """Nearest documents, then the neighbourhood of the first five, in one ranking."""
        types = tuple(node_types or ())
        hits = cut(self.vectors.search(query_text, max_results, types), "found")
        ranked = cut(
            rank_hits(
                self.store.node_rows,
                self.store.edge_rows,
                hits,
                max_results,
                expand_graph,
                graph_depth,
                types,
                filter_neighbours,
            ),
            "ranked",
        )
        numbers = {"query": query_text, "total_results": ranked.count(), "vector_results": hits.count()}
        return QueryResult(ranked, [F.col("rank")], numbers)

    def find_symbol(self, name: str, exact: bool = False) -> QueryResult:
        return QueryResult(lookup.find_symbol(self.store.nodes, name, exact), [F.col("id")])

    def find_definition(self, symbol_name: str) -> QueryResult:
        return QueryResult(lookup.find_definition(self.store.nodes, symbol_name), [F.col("id")])

    def find_references(self, symbol_id: str, max_results: int = 20) -> QueryResult:
        found = traversal.references(self.store.node_rows, self.store.edge_rows, symbol_id, max_results)
        return QueryResult(found, [F.col("depth"), F.col("id")])

    def get_file_summary(self, file_path: str) -> QueryResult:
        symbols = self.traversal.get_file_symbols(f"file:{file_path}")
        symbols = cut(symbols.withColumn("score", F.lit(1.0)), "summary")
        counts = symbols.agg(
            *[F.count_if(F.col("bucket") == b).alias(b) for b in ("functions", "classes", "imports")]
        ).first()
        return QueryResult(
            symbols, [lookup.bucket_order(), F.col("ord"), F.col("id")], {"file_path": file_path, **counts.asDict()}
        )
