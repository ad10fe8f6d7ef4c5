"""Point lookups, filters and the joins that hang one hop off a node."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOL_TYPES = ("function", "class", "import", "variable")
# Bucket names and their order in a file summary.
BUCKETS = {"function": "functions", "class": "classes", "import": "imports", "variable": "variables"}


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


def nodes_of_type(nodes: DataFrame, *types: str) -> DataFrame:
    """Nodes of the given types; no types means no filter."""
    return nodes.filter(F.col("type").isin(*types)) if types else nodes


# The fields of each node type beside id, type, name and metadata.
FIELDS = {
    "file": ("path", "language", "last_modified", "size_bytes", "line_count"),
    "function": ("file_id", "signature", "docstring", "start_line", "end_line", "is_async", "is_method", "class_id",
                 "parameters", "return_type"),
    "class": ("file_id", "docstring", "start_line", "end_line", "bases", "decorators"),
    "import": ("file_id", "module", "alias", "items", "line"),
    "variable": ("file_id", "type_hint", "line", "scope", "class_id"),
}


def typed_nodes(nodes: DataFrame, node_type: str) -> DataFrame:
    """Nodes of one type with the fields of that type only, so that no other column is read."""
    return nodes_of_type(nodes, node_type).select("id", "type", "name", "metadata", *FIELDS[node_type])


def nodes_by_name(nodes: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """Exact: same letters, same case. Otherwise: contained, case ignored; '' is in every name."""
    if exact:
        return nodes.filter(F.col("name") == name)
    return nodes.filter(F.lower("name").contains(name.lower()))


def edges_from(edges: DataFrame, node_id: str, edge_type: str | None = None) -> DataFrame:
    found = edges.filter(F.col("source_id") == node_id)
    return found.filter(F.col("type") == edge_type) if edge_type else found


def edges_to(edges: DataFrame, node_id: str, edge_type: str | None = None) -> DataFrame:
    found = edges.filter(F.col("target_id") == node_id)
    return found.filter(F.col("type") == edge_type) if edge_type else found


def search_nodes(
    nodes: DataFrame,
    predicate: Column | Callable,
    types: Iterable[str] = (),
    columns: Iterable[str] | None = None,
    vectorized: bool = False,
) -> DataFrame:
    """Nodes that satisfy a predicate.

    A Column stays inside the compiled plan and is the first choice. A Python callable gets each node's
    fields as a dict, after the type filter; naming `columns` spares the others the way out of the JVM.
    With `vectorized` it gets a pandas DataFrame of many nodes and returns a Series of truth values.
    """
    kept = nodes_of_type(nodes, *types)
    if not isinstance(predicate, Column):
        test, fields = predicate, F.struct(*(columns or nodes.columns))
        if vectorized:
            accepts = F.pandas_udf(lambda rows: test(rows).astype(bool), T.BooleanType())
        else:
            accepts = F.udf(lambda row: bool(test(row.asDict(recursive=True))), T.BooleanType(), useArrow=True)
        predicate = accepts(fields)
    return kept.filter(predicate)


def find_symbol(nodes: DataFrame, name: str, exact: bool = False) -> DataFrame:
    return nodes_by_name(nodes, name, exact).withColumn("score", F.lit(1.0 if exact else 0.9))


def find_definition(nodes: DataFrame, name: str) -> DataFrame:
    """Functions and classes of exactly this name, score 1.0."""
    found = nodes_by_name(nodes_of_type(nodes, "function", "class"), name)
    return found.withColumn("score", F.lit(1.0))


def file_symbols(nodes: DataFrame, edges: DataFrame, file_id: str | None = None) -> DataFrame:
    """Symbols one edge away from a file (or from every file), tagged with their bucket.

    Methods hang off their class and so do not appear. One row per symbol: a file with very many
    symbols never has to fit one array.
    """
    if file_id is None:
        files = edges.filter(F.col("source_id").startswith("file:"))
    else:
        files = edges.filter(F.col("source_id") == file_id)
    pairs = files.select(F.col("source_id").alias("symbol_of"), F.col("target_id").alias("id")).distinct()
    bucket = F.lit(None).cast("string")
    for kind, name in BUCKETS.items():
        bucket = F.when(F.col("type") == kind, name).otherwise(bucket)
    return nodes_of_type(nodes, *SYMBOL_TYPES).join(pairs, "id").withColumn("bucket", bucket)


def bucket_order() -> Column:
    order = F.lit(len(BUCKETS))
    for i, name in enumerate(BUCKETS.values()):
        order = F.when(F.col("bucket") == name, F.lit(i)).otherwise(order)
    return order


def dependencies(nodes: DataFrame, edges: DataFrame, file_id: str | None = None) -> DataFrame:
    """Distinct modules a file imports, sorted; for all files without `file_id`."""
    imports = edges.filter(F.col("type") == "imports")
    if file_id is not None:
        imports = imports.filter(F.col("source_id") == file_id)
    modules = nodes.filter(F.col("type") == "import").select("id", "module")
    found = (
        imports.join(modules, imports["target_id"] == modules["id"])
        .select(imports["source_id"].alias("file_id"), "module")
        .distinct()
    )
    return found.orderBy("file_id", "module")


def dependents(nodes: DataFrame, module: str | None = None) -> DataFrame:
    """Files with an import of `module`, once per import: importing twice shows twice."""
    imports = nodes.filter(F.col("type") == "import")
    if module is not None:
        imports = imports.filter(F.col("module") == module)
    imports = imports.select(
        F.col("module").alias("imported"), F.col("id").alias("import_id"), F.col("file_id").alias("importer")
    )
    return nodes.join(imports, F.col("id") == F.col("importer")).drop("importer")


def incident_edges_with_nodes(nodes: DataFrame, edges: DataFrame, end: str = "target_id") -> DataFrame:
    """Edges joined with the node at one end; edges to undefined nodes drop out."""
    far = nodes.select(
        F.col("id").alias("node_id"), F.col("type").alias("node_type"), F.col("name").alias("node_name")
    )
    return edges.join(far, edges[end] == far["node_id"])
