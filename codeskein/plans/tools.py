"""The six tools an assistant may call, as functions that return text.

Serving them over a wire is left to the caller.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from codeskein.operators import export
from codeskein.plans.engine import QueryEngine
from codeskein.plans.indexer import CodeIndexer
from codeskein.search import VectorStore
from codeskein.store import GraphStore

# Tool names, and which node types a caller may ask for.
TOOLS = ("query", "find_definition", "find_references", "file_summary", "graph_stats", "index")
SELECTABLE_TYPES = ("function", "class", "file", "import")


def types_for(choice: str) -> tuple[str, ...]:
    """`any` and unknown words mean no filter."""
    return (choice,) if choice in SELECTABLE_TYPES else ()


class Tools:
    def __init__(self, spark: SparkSession, root: str, data_path: str | None = None):
        folder = data_path or f"{root}/.codeskein"
        self.store = GraphStore(spark, f"{folder}/graph")
        self.indexer = CodeIndexer(root, self.store)
        self.engine = QueryEngine(self.store, VectorStore(spark, f"{folder}/vectors"))

    def call(self, name: str, arguments: dict) -> str:
        """Run a tool by name; problems come back as text."""
        if name not in TOOLS:
            return f"Unknown tool: {name}"
        try:
            return getattr(self, name)(**arguments)
        except Exception as error:
            return f"Error: {error}"

    def query(self, query: str, type: str = "any", max_results: int = 10) -> str:
        result = self.engine.query(query, types_for(type), max_results)
        return result.context or "No results found"

    def find_definition(self, symbol: str) -> str:
        return self.engine.find_definition(symbol).context or f"No definition found for '{symbol}'"

    def find_references(self, symbol: str) -> str:
        first = self.engine.find_definition(symbol).nodes.orderBy("id").select("id").first()
        if first is None:
            return f"Symbol '{symbol}' not found"
        return self.engine.find_references(first["id"]).context or f"No references found for '{symbol}'"

    def file_summary(self, file_path: str) -> str:
        result = self.engine.get_file_summary(file_path)
        if result.nodes.isEmpty():
            return f"No symbols found in '{file_path}'"
        n = result.metadata
        head = f"File: {file_path}\nFunctions: {n['functions']}\nClasses: {n['classes']}\nImports: {n['imports']}\n\n"
        return head + result.context

    def graph_stats(self) -> str:
        return export.stats_text(self.store.nodes, self.store.edges).first()["text"]

    def index(self, incremental: bool = True) -> str:
        """Index without resolving references, then renew the vectors."""
        if incremental:
            title, labels = "Incremental index complete:", ("files_added", "files_modified", "files_deleted")
            counts = self.indexer.index_incremental()
        else:
            title, labels = "Full index complete:", ("files_processed", "functions", "classes")
            counts = self.indexer.index_full()
        lines = [title]
        lines += [f"- {label.replace('_', ' ').capitalize()}: {counts.get(label, 0)}" for label in labels]
        lines.append(f"- Vector embeddings: {self.engine.index_vectors()}")
        return "\n".join(lines) + "\n"
