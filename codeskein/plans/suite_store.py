"""Registered queries over what users hold: the stored graph, the document collection, the query engine."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeskein.plans import suite_sql as sql
from codeskein.plans import table_graph
from codeskein.plans.engine import QueryEngine
from codeskein.plans.suite import NODE_COLUMNS, SUITE, _HYBRID, _RANKED_HITS, _RESULT, _WORDS, _result, query
from codeskein.search import VectorStore
from codeskein.session import work_folder
from codeskein.store import GraphStore


def _filled(spark, folder: str) -> GraphStore:
    """The graph of a table folder in a store of its own, laid out for lookups from a thousand rows on."""
    graph = table_graph.stored(spark, folder)
    store = GraphStore(spark, f"{work_folder(spark)}/graph-{uuid.uuid4().hex}", small=1000)
    store.replace_all({"nodes": graph.nodes, "edges": graph.edges, "references": graph.references})
    return store


_STORES: dict[tuple[str, str], GraphStore] = {}


def _stored(spark, folder: str) -> GraphStore:
    """The same for queries that only read: filled once a session, with one change that a reader has to merge."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORES:
        store = _filled(spark, folder)
        store.add_nodes(store.nodes.filter("type = 'class'"))
        store.add_edges(store.edges.filter("type = 'inherits'"))
        _STORES[key] = store
    return _STORES[key]


_CHANGED = """
renamed AS (SELECT id, type, CASE WHEN id IN (SELECT 'func:' || o_orderkey FROM orders WHERE o_orderkey % 100 = 5) THEN 'changed' ELSE name END AS name,
            coalesce(file_id, id) AS owner FROM nodes),
gone AS (SELECT id FROM renamed WHERE owner IN (SELECT id FROM fileset WHERE language = 'go')),
kept AS (SELECT * FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone))"""


@query(sql.graph(
    """SELECT 'node' AS part, id, name, type FROM renamed WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT DISTINCT 'edge', source_id, target_id, type FROM kept""", _CHANGED))
def s8_store_changes(spark, folder):
    """Nodes replaced by id, then the files of one language removed with all that hangs on them."""
    store = _filled(spark, folder)
    some = store.nodes.filter("type = 'function'").filter(F.substring_index("id", ":", -1).cast("long") % 100 == 5)
    store.add_nodes(some.withColumn("name", F.lit("changed")))
    go = store.nodes.filter("type = 'file' AND language = 'go'").select(F.col("id").alias("file_id"))
    store.remove_files(go)
    nodes = store.nodes.select(F.lit("node").alias("part"), "id", "name", "type")
    edges = store.edges.select(F.lit("edge").alias("part"), F.col("source_id").alias("id"), F.col("target_id").alias("name"), "type")
    return nodes.unionByName(edges.distinct())


@query(sql.graph(
    """SELECT id, name, CASE type WHEN 'function' THEN 'functions' WHEN 'class' THEN 'classes' WHEN 'import' THEN 'imports' ELSE 'variables' END AS bucket
FROM nodes WHERE type <> 'file' AND id IN (SELECT target_id FROM edges WHERE source_id = 'file:src/' || (SELECT name FROM file_rows WHERE nation = 3) || '')"""))
def i6_engine_file_summary(spark, folder):
    engine = QueryEngine(_stored(spark, folder))
    path = table_graph.files(spark, folder).filter("nation = 3").first()["path"]
    return engine.get_file_summary(path).nodes.select("id", "name", "bucket")


_TEXTS = """
texts AS (SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 10 = 3 THEN 'rare words: zebra ' || coalesce(source, '') ELSE text END AS document,
          lang AS type, source AS name FROM documents WHERE doc_id % 10 <> 4)"""


def _collection(spark, folder: str) -> VectorStore:
    """All documents, a tenth of them replaced and a tenth removed afterwards."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.select("doc_id", F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("document"), F.col("lang").alias("type"), F.col("source").alias("name"))
    store = VectorStore(spark, f"{work_folder(spark)}/vectors-{uuid.uuid4().hex}")
    store.replace_all(rows)
    changed = F.concat(F.lit("rare words: zebra "), F.coalesce("name", F.lit("")))
    store.add(rows.filter("doc_id % 10 = 3").withColumn("document", changed))
    store.delete_where(F.substring("id", 2, 20).cast("long") % 10 == 4)
    return store


@query("WITH " + _TEXTS + " SELECT id, document, type, name FROM texts")
def s10_collection_changes(spark, folder):
    return _collection(spark, folder).documents.select("id", "document", "type", "name")


@query("WITH " + _TEXTS + """,
bags AS (SELECT id, unnest(list_filter(string_split_regex(lower(document), '[^a-z0-9]+'), lambda w: w <> '')) AS word FROM texts WHERE name <> 'src1'),
counted AS (SELECT id, word, count(*)::DOUBLE AS n FROM bags GROUP BY ALL),
lengths AS (SELECT id, sqrt(sum(n * n)) AS length FROM counted GROUP BY id),
hits AS (SELECT id, round(1 - n / length / 1, 12) AS distance FROM counted JOIN lengths USING (id) WHERE word = 'zebra')
SELECT (row_number() OVER (ORDER BY distance, id))::INTEGER AS rank, id, round(distance, 6) AS distance, document FROM hits JOIN texts USING (id)
ORDER BY distance, id LIMIT 10""")
def k1_collection_search(spark, folder):
    """The nearest documents to a word that only replaced documents have, one source left out by a condition."""
    store = _collection(spark, folder)
    hits = store.with_documents(store.search("zebra", 10, where=F.col("name") != "src1"))
    return hits.select("rank", "id", F.round("distance", 6).alias("distance"), "document")


# --- the lookups and walks of the suite through a store, which opens only the files that may hold what is asked for ---


def _twin(name: str) -> str:
    return SUITE[name].oracle


@query(_twin("f1_node"))
def f1_stored_node(spark, folder):
    return _stored(spark, folder).get_node("func:17").selectExpr(*NODE_COLUMNS.split(", "))


@query(_twin("f2_nodes_by_type"))
def f2_stored_nodes_by_type(spark, folder):
    return _stored(spark, folder).get_nodes_by_type("import").select("id", "name", "file_id", "module", "line")


@query(_twin("f4_edges_from"))
def f4_stored_edges_from(spark, folder):
    return _stored(spark, folder).get_edges_from("class:33").select("source_id", "target_id", "type")


@query(_twin("f4_edges_to"))
def f4_stored_edges_to(spark, folder):
    return _stored(spark, folder).get_edges_to("func:7", "calls").select("source_id", "target_id", "type")


@query(_twin("t1_related"))
def t1_stored_related(spark, folder):
    found = QueryEngine(_stored(spark, folder)).traversal.get_related_symbols("class:12")
    return found.select("id", "type", "name", "depth")


@query(_twin("t2_callers"))
def t2_stored_callers(spark, folder):
    return QueryEngine(_stored(spark, folder)).traversal.find_callers("func:5").select("id", "name", "depth")


@query(_twin("t3_callees"))
def t3_stored_callees(spark, folder):
    return QueryEngine(_stored(spark, folder)).traversal.find_callees("func:149").select("id", "name", "depth")


@query(_twin("t5_subclasses"))
def t5_stored_subclasses(spark, folder):
    return QueryEngine(_stored(spark, folder)).traversal.find_subclasses("class:7").select("id", "name")


@query(_twin("t6_references_of_class"))
def t6_stored_references(spark, folder):
    return QueryEngine(_stored(spark, folder)).find_references("class:2").nodes.select("id", "depth", "score")


@query(_twin("j10_references_of_definition"))
def j10_stored_references(spark, folder):
    engine = QueryEngine(_stored(spark, folder))
    first = engine.find_definition("fn_1").nodes.orderBy("id").first()
    return engine.find_references(first["id"]).nodes.select("id", "name", "depth")


_ASKED = "fn 12 class 7 src"
#: The words of the nodes' own documents in place of those of the table of documents.
_NODE_WORDS = _WORDS.format(question=_ASKED)
_NODE_WORDS = "texts AS (" + _twin("x3_documents").rsplit("\n", 3)[-3] + "\n" + "\n".join(_twin("x3_documents").rsplit("\n", 2)[-2:]) + """),
docs AS (SELECT texts.id, nodes.type, list_filter(string_split_regex(lower(document), '[^a-z0-9]+'), lambda w: w <> '') AS words
         FROM texts JOIN nodes USING (id) WHERE document <> '')""" + _NODE_WORDS[_NODE_WORDS.index(",\ncounted") :]


@query(sql.graph(_RESULT, _NODE_WORDS, _RANKED_HITS.format(k=10), _HYBRID.format(k=10, depth=1)))
def i5_engine_query(spark, folder):
    """The engine's own query: vectors of all nodes, the nearest to a text, the graph around them, one ranking."""
    engine = QueryEngine(_stored(spark, folder))
    engine.index_vectors()
    found = _result(engine.query(_ASKED).nodes)
    engine.vectors.close()
    return found


@query("WITH " + _TEXTS + """ SELECT id, document, n FROM texts, (SELECT count(*) AS n FROM texts) WHERE id IN ('d3', 'd4', 'd5', 'none')""")
def s11_get_and_count(spark, folder):
    store = _collection(spark, folder)
    return store.get(["d3", "d4", "d5", "none"]).select("id", "document", F.lit(store.count()).alias("n"))
