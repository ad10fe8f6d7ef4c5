"""A knowledge graph of source code, held and queried as Spark DataFrames."""

from codeskein.parsing.registry import ParserRegistry
from codeskein.plans.engine import GraphTraversal, QueryEngine
from codeskein.plans.indexer import CodeIndexer
from codeskein.search import VectorStore
from codeskein.session import local_session
from codeskein.store import GraphStore

__all__ = ["CodeIndexer", "GraphStore", "GraphTraversal", "ParserRegistry", "QueryEngine", "VectorStore", "local_session"]
