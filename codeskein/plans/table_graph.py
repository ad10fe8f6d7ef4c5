"""A property graph laid over plain relational tables.

Nations play files, customers classes, orders functions, suppliers imports and parts variables;
foreign keys become edges. It lets every graph operator run over tables of any size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeskein.functions import paths
from codeskein.schema import EDGES, NODES, conform
from codeskein.session import cut, release


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    references: DataFrame


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _id(kind: str, column: str) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    endings = F.array(*[F.lit(s) for s in (".py", ".ts", ".js", ".go", ".rs")])
    name = F.concat(F.lower("n_name"), F.get(endings, F.col("n_nationkey") % 5))
    path = F.concat(F.lit("src/"), name)
    return _table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("nation"),
        F.col("n_regionkey").alias("region"),
        paths.file_id(path).alias("id"),
        name.alias("name"),
        path.alias("path"),
        paths.language(path).alias("language"),
        (F.col("n_nationkey") * 100).cast("long").alias("size_bytes"),
        F.col("n_nationkey").alias("line_count"),
    )


def _of_nations(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).select("nation", "region", F.col("id").alias("file_id"))


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "customer").join(_of_nations(spark, folder), F.col("c_nationkey") == F.col("nation"))


def _placed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the file of their customer.

    Either side grows with the input; by the compressed size of a few columns Spark would send millions of rows through the driver.
    """
    customer = _customers(spark, folder).select("c_custkey", "file_id").hint("merge")
    orders = _table(spark, folder, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "file_id")


def build(spark: SparkSession, folder: str, orders: DataFrame | None = None) -> Graph:
    """Nodes, edges and references of one table folder, all lazy; `orders` are those with their files, if written already."""
    file_rows, of_nation, customer = files(spark, folder), _of_nations(spark, folder), _customers(spark, folder)
    orders = _placed_orders(spark, folder) if orders is None else orders
    supplier = _table(spark, folder, "supplier").join(of_nation, F.col("s_nationkey") == F.col("nation"))
    part = _table(spark, folder, "part").join(of_nation, F.col("p_partkey") % 25 == F.col("nation"))
    lineitem = _table(spark, folder, "lineitem")

    is_method = F.col("o_orderkey") % 10 != 0
    fn_name = F.concat(F.lit("fn_"), (F.col("o_orderkey") % 1000).cast("string"))
    start = (F.col("o_orderkey") % 1000 + 1).cast("int")
    classes = customer.select(
        _id("class", "c_custkey").alias("id"),
        F.lit("class").alias("type"),
        F.concat(F.lit("Class_"), (F.col("c_custkey") % 500).cast("string")).alias("name"),
        "file_id",
        F.col("c_mktsegment").alias("docstring"),
        (F.col("c_custkey") % 100 + 1).cast("int").alias("start_line"),
        (F.col("c_custkey") % 100 + 11).cast("int").alias("end_line"),
        F.when(F.col("c_custkey") % 3 == 0, F.array("c_mktsegment")).otherwise(F.array()).alias("bases"),
        F.col("c_custkey").cast("long").alias("ord"),
    )
    functions = orders.select(
        _id("func", "o_orderkey").alias("id"),
        F.lit("function").alias("type"),
        fn_name.alias("name"),
        "file_id",
        F.when(is_method, _id("class", "o_custkey")).alias("class_id"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("def "), fn_name, F.lit("("), F.col("o_orderstatus"), F.lit(")")))
        .alias("signature"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("docstring"),
        start.alias("start_line"),
        (start + F.col("o_orderkey") % 50).cast("int").alias("end_line"),
        (F.col("o_orderkey") % 4 == 0).alias("is_async"),
        is_method.alias("is_method"),
        F.array("o_orderstatus").alias("parameters"),
        F.col("o_orderkey").cast("long").alias("ord"),
    )
    module = F.concat(F.lit("region_"), F.col("region").cast("string"))
    imports = supplier.select(
        _id("import", "s_suppkey").alias("id"),
        F.lit("import").alias("type"),
        module.alias("name"),
        "file_id",
        module.alias("module"),
        (F.col("s_suppkey") % 50 + 1).cast("int").alias("line"),
    )
    variables = part.select(
        _id("var", "p_partkey").alias("id"),
        F.lit("variable").alias("type"),
        F.col("p_name").alias("name"),
        "file_id",
        F.col("p_brand").alias("type_hint"),
        F.col("p_size").alias("line"),
        F.lit("module").alias("scope"),
    )
    file_nodes = file_rows.drop("nation", "region").withColumn("type", F.lit("file"))
    nodes = reduce(
        DataFrame.unionByName,
        [conform(part_of, NODES) for part_of in (file_nodes, classes, functions, imports, variables)],
    )

    def edge(rows: DataFrame, source, target, kind: str, position=None) -> DataFrame:
        return rows.select(
            source.alias("source_id"),
            target.alias("target_id"),
            F.lit(kind).alias("type"),
            (F.lit(0) if position is None else position).cast("long").alias("ord"),
        )

    file_of = F.col("file_id")
    parent = F.concat(F.lit("class:"), F.floor(F.col("c_custkey") / 2).cast("string"))
    elder = F.concat(F.lit("class:"), (F.col("c_custkey") - 1).cast("string"))
    edges = [
        edge(customer, file_of, _id("class", "c_custkey"), "defines"),
        edge(orders.filter(~is_method), file_of, _id("func", "o_orderkey"), "defines"),
        edge(orders.filter(is_method), _id("class", "o_custkey"), _id("func", "o_orderkey"), "contains"),
        edge(supplier, file_of, _id("import", "s_suppkey"), "imports"),
        edge(customer.filter("c_custkey > 0"), _id("class", "c_custkey"), parent, "inherits"),
        edge(customer.filter("c_custkey % 10 = 3"), _id("class", "c_custkey"), elder, "inherits", F.lit(1)),
        edge(
            orders.filter("o_orderkey <> o_custkey"), _id("func", "o_orderkey"), _id("func", "o_custkey"), "calls"
        ),
        edge(
            lineitem.select("l_orderkey", "l_partkey").distinct(),
            _id("func", "l_orderkey"),
            _id("var", "l_partkey"),
            "uses",
        ),
        # What real trees have as well: undefined targets, a second type between two nodes, loops, cycles.
        edge(
            orders.filter("o_orderkey % 50 = 1"),
            _id("func", "o_orderkey"),
            F.concat(F.lit("func:gone_"), (F.col("o_orderkey") % 7).cast("string")),
            "calls",
        ),
        edge(orders.filter("o_orderkey % 20 = 2"), _id("func", "o_orderkey"), _id("func", "o_custkey"), "uses"),
        edge(orders.filter("o_orderkey % 40 = 3"), _id("func", "o_orderkey"), _id("func", "o_orderkey"), "uses"),
        edge(orders.filter("o_orderkey % 60 = 7"), _id("func", "o_custkey"), _id("func", "o_orderkey"), "uses"),
        edge(customer.filter("c_custkey = 0"), _id("class", "c_custkey"), F.lit("class:1"), "inherits", F.lit(2)),
    ]
    called = F.concat(F.lit("fn_"), (F.col("o_orderkey") * 7 % 1500).cast("string"))
    base = F.concat(F.lit("Class_"), (F.col("c_custkey") * 3 % 800).cast("string"))
    open_references = [
        edge(orders, _id("func", "o_orderkey"), paths.placeholder(F.lit("calls"), called), "calls"),
        edge(customer, _id("class", "c_custkey"), paths.placeholder(F.lit("inherits"), base), "inherits"),
    ]
    unresolved = F.create_map(F.lit("unresolved"), F.lit("true"))
    return Graph(
        nodes,
        reduce(DataFrame.unionByName, [conform(e, EDGES) for e in edges]),
        reduce(DataFrame.unionByName, [conform(r.withColumn("metadata", unresolved), EDGES) for r in open_references]),
    )


_written: dict[tuple[str, str], Graph] = {}


def stored(spark: SparkSession, folder: str) -> Graph:
    """`build`, written once per application, as a graph that many queries share would be."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _written:
        orders = cut(_placed_orders(spark, folder), "orders")
        graph = build(spark, folder, orders)
        # By type, as most questions name the types they follow.
        _written[key] = Graph(
            cut(graph.nodes, "nodes", "type"), cut(graph.edges, "edges", "type"), cut(graph.references, "references")
        )
        release(orders)
    return _written[key]


def embedded(spark: SparkSession, folder: str) -> DataFrame:
    """(id, type, embedding): every third vector belongs to a class, the others to functions."""
    is_class = F.col("vec_id") % 3 == 0
    return _table(spark, folder, "embeddings").select(
        F.when(is_class, _id("class", "vec_id")).otherwise(_id("func", "vec_id")).alias("id"),
        F.when(is_class, F.lit("class")).otherwise(F.lit("function")).alias("type"),
        "embedding",
    )
