"""Every operator as a named query over a table folder, with its SQL twin where SQL can say it."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeskein.functions import paths, text, vectors
from codeskein.operators import aggregates, changes, export, lookup, ranking, resolve, sets, traversal
from codeskein.plans import hybrid, table_graph
from codeskein.plans import suite_sql as sql
from codeskein.session import cut, spread, work_folder
from codeskein.streaming import events as file_events

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    oracle: str | None = None


SUITE: dict[str, Entry] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        SUITE[run.__name__] = Entry(run, oracle)
        return run

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- counts, degrees, centrality -------------------------------------------------------------


@query(
    sql.graph(
        """SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type
UNION ALL SELECT 'node', 'unknown', count(*) FROM undefined
UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type"""
    )
)
def a2_type_counts(spark, folder):
    # Straight from the tables, so that the query also measures building the graph.
    g = table_graph.build(spark, folder)
    # Each side is read twice: once for its types, once for the ids that edges mention and no node has.
    nodes = cut(g.nodes.select("id", "type"), "nodes")
    edges = cut(g.edges.select("source_id", "target_id", "type"), "edges")
    return aggregates.type_counts(nodes, edges)


@query(sql.graph("SELECT (SELECT count(*) FROM nodes) + (SELECT count(*) FROM undefined) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges"))
def a1_totals(spark, folder):
    g = table_graph.stored(spark, folder)
    return aggregates.totals(g.nodes, g.edges)


@query(
    sql.graph(
        """SELECT nodes.id, coalesce(d.n, 0) / 2.0::DOUBLE AS complexity FROM nodes LEFT JOIN (
  SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM pairs UNION ALL SELECT target_id FROM pairs)
  GROUP BY id) d USING (id)""",
        "pairs AS (SELECT DISTINCT source_id, target_id FROM edges)",
    )
)
def a5_complexity(spark, folder):
    g = table_graph.stored(spark, folder)
    return aggregates.complexity(g.nodes, g.edges)


@query(
    sql.graph(
        """SELECT 'func:3' AS id, count(*) / 2.0::DOUBLE AS complexity FROM
 (SELECT source_id AS id FROM pairs UNION ALL SELECT target_id FROM pairs) WHERE id = 'func:3'""",
        "pairs AS (SELECT DISTINCT source_id, target_id FROM edges)",
    )
)
def a5_complexity_of_one(spark, folder):
    g = table_graph.stored(spark, folder)
    return aggregates.complexity_of(g.edges, "func:3")


@query(sql.graph("SELECT id, round(rank, 9) AS rank FROM r5", sql.pagerank(5)))
def a6_pagerank_five_steps(spark, folder):
    g = table_graph.stored(spark, folder)
    ranks = aggregates.pagerank(g.nodes, g.edges, max_iterations=5, tolerance=None)
    return ranks.select("id", F.round("rank", 9).alias("rank"))


@query(
    sql.graph(
        """SELECT id, nodes.type, nodes.name, round(rank, 9) AS score FROM
 (SELECT id, rank FROM final ORDER BY rank DESC, id LIMIT 10) JOIN nodes USING (id)""",
        sql.pagerank(30),
        sql.settled(30),
    )
)
def a6_central_nodes(spark, folder):
    g = table_graph.stored(spark, folder)
    best = aggregates.central_nodes(g.nodes, g.edges, 10)
    return best.select("id", "type", "name", F.round("score", 9).alias("score"))


@query(
    sql.graph(
        """SELECT source_id AS file_id, count(*) FILTER (WHERE n.type = 'function') AS functions,
 count(*) FILTER (WHERE n.type = 'class') AS classes, count(*) FILTER (WHERE n.type = 'import') AS imports
FROM (SELECT DISTINCT source_id, target_id FROM edges WHERE source_id LIKE 'file:%') e
JOIN nodes n ON n.id = e.target_id GROUP BY source_id"""
    )
)
def a7_file_summary_counts(spark, folder):
    g = table_graph.stored(spark, folder)
    symbols = lookup.file_symbols(g.nodes, g.edges)
    return symbols.groupBy(F.col("symbol_of").alias("file_id")).agg(
        *[F.count_if(F.col("bucket") == b).alias(b) for b in ("functions", "classes", "imports")]
    )


@query("SELECT text_id, lines::INTEGER AS lines FROM (SELECT doc_id AS text_id, "
       "length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) "
       "THEN 1 ELSE 0 END AS lines FROM documents)")
def a11_line_counts(spark, folder):
    return _table(spark, folder, "documents").select(
        F.col("doc_id").alias("text_id"), paths.line_count(F.col("text")).alias("lines")
    )


# --- lookups and filters ---------------------------------------------------------------------

NODE_COLUMNS = "id, type, name, file_id, class_id, signature, docstring, start_line, end_line, is_async, is_method"
_BRIEF = ("id", "type", "name")


@query(sql.graph(f"SELECT {NODE_COLUMNS} FROM nodes WHERE id = 'func:17'"))
def f1_node(spark, folder):
    return lookup.node(table_graph.stored(spark, folder).nodes, "func:17").selectExpr(*NODE_COLUMNS.split(", "))


@query(sql.graph("SELECT id, name, file_id, module, line FROM nodes WHERE type = 'import'"))
def f2_nodes_by_type(spark, folder):
    nodes = table_graph.stored(spark, folder).nodes
    return lookup.nodes_of_type(nodes, "import").select("id", "name", "file_id", "module", "line")


@query(sql.graph("SELECT id, type, name FROM nodes WHERE name = 'fn_12'"))
def f3_name_exact(spark, folder):
    return lookup.nodes_by_name(table_graph.stored(spark, folder).nodes, "fn_12").select(*_BRIEF)


@query(sql.graph("SELECT id, type, name FROM nodes WHERE contains(lower(name), 'n_1')"))
def f3_name_contains(spark, folder):
    return lookup.nodes_by_name(table_graph.stored(spark, folder).nodes, "N_1", exact=False).select(*_BRIEF)


@query(sql.graph("SELECT source_id, target_id, type FROM edges WHERE source_id = 'class:33'"))
def f4_edges_from(spark, folder):
    return lookup.edges_from(table_graph.stored(spark, folder).edges, "class:33").select("source_id", "target_id", "type")


@query(sql.graph("SELECT source_id, target_id, type FROM edges WHERE target_id = 'func:7' AND type = 'calls'"))
def f4_edges_to(spark, folder):
    found = lookup.edges_to(table_graph.stored(spark, folder).edges, "func:7", "calls")
    return found.select("source_id", "target_id", "type")


@query(sql.graph("SELECT id, type, name FROM nodes WHERE type IN ('function', 'class') AND end_line - start_line > 40"))
def f5_search_nodes(spark, folder):
    nodes = table_graph.stored(spark, folder).nodes
    long_ones = F.col("end_line") - F.col("start_line") > 40
    return lookup.search_nodes(nodes, long_ones, ["function", "class"]).select(*_BRIEF)


@query(sql.graph("SELECT id, type, name FROM nodes WHERE type = 'variable' AND name[1:3] = 'red'"))
def f5_search_nodes_by_callable(spark, folder):
    nodes = table_graph.stored(spark, folder).nodes
    return lookup.search_nodes(nodes, lambda n: n["name"].startswith("red"), ["variable"]).select(*_BRIEF)


@query(sql.graph("SELECT id, type, name, 0.9::DOUBLE AS score FROM nodes WHERE contains(lower(name), 'widget')"))
def f6_find_symbol(spark, folder):
    return lookup.find_symbol(table_graph.stored(spark, folder).nodes, "Widget").select(*_BRIEF, "score")


@query(
    sql.graph(
        "SELECT id, type, name, 1.0::DOUBLE AS score FROM nodes WHERE name = 'Class_77' AND type IN ('function', 'class')"
    )
)
def f7_find_definition(spark, folder):
    return lookup.find_definition(table_graph.stored(spark, folder).nodes, "Class_77").select(*_BRIEF, "score")


@query(sql.graph("SELECT id, name, file_id, class_id, is_async, start_line, end_line FROM nodes WHERE type = 'function'"))
def f9_functions(spark, folder):
    functions = lookup.typed_nodes(table_graph.stored(spark, folder).nodes, "function")
    return functions.select("id", "name", "file_id", "class_id", "is_async", "start_line", "end_line")


@query(
    sql.graph(
        """SELECT id, replace(coalesce(file_id, ''), 'file:', '') || CASE WHEN file_id IS NOT NULL AND start_line IS NOT NULL
 THEN ':' || start_line || '-' || end_line ELSE '' END AS location FROM nodes"""
    )
)
def f11_locations(spark, folder):
    nodes = table_graph.stored(spark, folder).nodes
    return nodes.select("id", paths.location(F.col("file_id"), F.col("start_line"), F.col("end_line")).alias("location"))


# --- joins -----------------------------------------------------------------------------------


@query(
    sql.graph(
        """SELECT source_id, target_id, e.type, n.type AS node_type, n.name AS node_name
FROM edges e JOIN nodes n ON n.id = e.target_id"""
    )
)
def j2_edges_with_far_node(spark, folder):
    g = table_graph.stored(spark, folder)
    joined = lookup.incident_edges_with_nodes(g.nodes, g.edges)
    return joined.select("source_id", "target_id", "type", "node_type", "node_name")


@query(
    sql.graph(
        """SELECT e.source_id AS symbol_of, n.id, n.name, CASE n.type WHEN 'function' THEN 'functions'
 WHEN 'class' THEN 'classes' WHEN 'import' THEN 'imports' ELSE 'variables' END AS bucket
FROM (SELECT DISTINCT source_id, target_id FROM edges WHERE source_id LIKE 'file:%') e
JOIN nodes n ON n.id = e.target_id WHERE n.type <> 'file'"""
    )
)
def j3_file_symbols(spark, folder):
    g = table_graph.stored(spark, folder)
    return lookup.file_symbols(g.nodes, g.edges).select("symbol_of", "id", "name", "bucket")


@query(
    sql.graph(
        """SELECT DISTINCT source_id AS file_id, n.module FROM edges e JOIN nodes n ON n.id = e.target_id
WHERE e.type = 'imports' AND n.type = 'import'"""
    )
)
def j4_dependencies(spark, folder):
    g = table_graph.stored(spark, folder)
    return lookup.dependencies(g.nodes, g.edges)


@query(
    sql.graph(
        """SELECT i.module AS imported, f.id, f.path FROM nodes i JOIN nodes f ON f.id = i.file_id
WHERE i.type = 'import' AND i.module = 'region_2'"""
    )
)
def j5_dependents(spark, folder):
    return lookup.dependents(table_graph.stored(spark, folder).nodes, "region_2").select("imported", "id", "path")


@query(
    sql.graph(
        """SELECT DISTINCT r.source_id, d.id AS target_id, r.type FROM open_refs r
JOIN definitions d ON d.type = r.wanted AND d.name = r.name""",
        """definitions AS (SELECT type, name, arg_max(id, (file_id, ord, id)) AS id FROM nodes
  WHERE type IN ('function', 'class') GROUP BY type, name)""",
    )
)
def j6_resolved_references(spark, folder):
    g = table_graph.stored(spark, folder)
    return resolve.resolved_edges(g.nodes, g.references).select("source_id", "target_id", "type")


@query(
    sql.graph(
        """SELECT id, name, depth FROM reached JOIN nodes USING (id) WHERE type = 'function' ORDER BY depth, id LIMIT 20""",
        """definition AS (SELECT id FROM nodes WHERE name = 'fn_1' AND type IN ('function', 'class') ORDER BY id LIMIT 1)""",
        """walk AS (SELECT id, 0 AS depth FROM definition UNION SELECT e.source_id, w.depth + 1 FROM walk w
  JOIN edges e ON e.target_id = w.id AND e.type = 'calls' WHERE w.depth < 4)""",
        """reached AS (SELECT id, min(depth)::INTEGER AS depth FROM walk WHERE id NOT IN (SELECT id FROM definition) GROUP BY id)""",
    )
)
def j10_references_of_definition(spark, folder):
    g = table_graph.stored(spark, folder)
    first = lookup.find_definition(g.nodes, "fn_1").orderBy("id").first()
    return traversal.references(g.nodes, g.edges, first["id"]).select("id", "name", "depth")


# --- traversal -------------------------------------------------------------------------------


@query(sql.graph("SELECT id, type, name, depth FROM reached JOIN nodes USING (id)",
                 sql.undirected(), sql.walk("class:12", 2, "a", "b", None, "links"), sql.reached("class:12")))
def t1_related(spark, folder):
    g = table_graph.stored(spark, folder)
    return traversal.related(g.nodes, g.edges, "class:12").select(*_BRIEF, "depth")


@query(sql.graph("SELECT id, type, name, depth FROM reached JOIN nodes USING (id)",
                 "links AS (SELECT source_id AS a, target_id AS b FROM edges WHERE type IN ('inherits', 'contains') "
                 "UNION SELECT target_id, source_id FROM edges WHERE type IN ('inherits', 'contains'))",
                 sql.walk("class:12", 3, "a", "b", None, "links"), sql.reached("class:12")))
def t1_related_by_edge_types(spark, folder):
    g = table_graph.stored(spark, folder)
    found = traversal.related(g.nodes, g.edges, "class:12", 3, ["inherits", "contains"])
    return found.select(*_BRIEF, "depth")


@query(sql.graph("SELECT id, name, depth FROM reached JOIN nodes USING (id)",
                 sql.walk("func:5", 4, "target_id", "source_id", "calls"), sql.reached("func:5")))
def t2_callers(spark, folder):
    g = table_graph.stored(spark, folder)
    return traversal.callers(g.nodes, g.edges, "func:5").select("id", "name", "depth")


@query(sql.graph("SELECT id, name, depth FROM reached JOIN nodes USING (id)",
                 sql.walk("func:149", 4, "source_id", "target_id", "calls"), sql.reached("func:149")))
def t3_callees(spark, folder):
    g = table_graph.stored(spark, folder)
    return traversal.callees(g.nodes, g.edges, "func:149").select("id", "name", "depth")


@query(
    sql.graph(
        "SELECT id, name, depth FROM walk JOIN nodes USING (id) WHERE depth > 0",
        """parents AS (SELECT source_id, arg_min(target_id, (ord, target_id)) AS target_id FROM edges
  WHERE type = 'inherits' GROUP BY source_id)""",
        """walk AS (SELECT 'class:143' AS id, 0 AS depth, ['class:143'] AS seen
  UNION ALL SELECT p.target_id, depth + 1, list_append(seen, p.target_id) FROM walk w
  JOIN parents p ON p.source_id = w.id WHERE NOT list_contains(seen, p.target_id))""",
    )
)
def t4_inheritance_chain(spark, folder):
    g = table_graph.stored(spark, folder)
    return traversal.inheritance_chain(g.nodes, g.edges, "class:143").select("id", "name", "depth")


@query(sql.graph("SELECT id, name FROM walk JOIN nodes USING (id) WHERE id <> 'class:7'",
                 sql.walk("class:7", None, "target_id", "source_id", "inherits")))
def t5_subclasses(spark, folder):
    g = table_graph.stored(spark, folder)
    return traversal.subclasses(g.nodes, g.edges, "class:7").select("id", "name")


@query(
    sql.graph(
        "SELECT DISTINCT n.id, n.name FROM edges e JOIN nodes n ON n.id = e.source_id "
        "WHERE e.type = 'inherits' AND e.target_id = 'class:7' AND n.id <> 'class:7'"
    )
)
def t5_direct_subclasses(spark, folder):
    g = table_graph.stored(spark, folder)
    return traversal.subclasses(g.nodes, g.edges, "class:7", recursive=False).select("id", "name")


@query(sql.graph("SELECT id, depth, 0.8::DOUBLE AS score FROM reached JOIN nodes USING (id) ORDER BY depth, id LIMIT 20",
                 sql.walk("class:2", 40, "target_id", "source_id", "inherits"), sql.reached("class:2")))
def t6_references_of_class(spark, folder):
    g = table_graph.stored(spark, folder)
    return traversal.references(g.nodes, g.edges, "class:2").select("id", "depth", "score")


# --- search, ranking, context ----------------------------------------------------------------

_QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 42)"
_DISTANCE = f"1 - list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}::DOUBLE[])"
_HITS = f"raw AS (SELECT id, type, {_DISTANCE} AS distance FROM vecs)"


def _query_vector(spark: SparkSession, folder: str) -> list[float]:
    row = _table(spark, folder, "embeddings").filter("vec_id = 42").select("embedding").first()
    return [float(x) for x in row["embedding"]]


@query(f"SELECT vec_id, round({_DISTANCE}, 6) AS distance FROM embeddings")
def x18_cosine_distances(spark, folder):
    vector = _query_vector(spark, folder)
    distance = vectors.cosine_distance(F.col("embedding"), vector)
    return _table(spark, folder, "embeddings").select("vec_id", F.round(distance, 6).alias("distance"))


@query(sql.graph(
    "SELECT row_number() OVER (ORDER BY distance, id)::INTEGER AS rank, id, round(distance, 6) AS distance FROM raw "
    "ORDER BY distance, id LIMIT 10", _HITS))
def k1_nearest(spark, folder):
    hits = ranking.nearest(table_graph.embedded(spark, folder), _query_vector(spark, folder))
    return hits.select("rank", "id", F.round("distance", 6).alias("distance"))


@query(sql.graph(
    "SELECT row_number() OVER (ORDER BY distance, id)::INTEGER AS rank, id, round(distance, 6) AS distance FROM raw "
    "WHERE type IN ('class') ORDER BY distance, id LIMIT 7", _HITS))
def k1_nearest_of_type(spark, folder):
    hits = ranking.nearest(table_graph.embedded(spark, folder), _query_vector(spark, folder), 7, ["class"])
    return hits.select("rank", "id", F.round("distance", 6).alias("distance"))


_RANKED_HITS = """
top AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS pos FROM raw ORDER BY distance, id LIMIT {k}),
hits AS (SELECT id, 1 - coalesce(distance, 0) AS score, row_number() OVER (ORDER BY pos) AS rank
         FROM top WHERE id IN (SELECT id FROM nodes))"""
_HYBRID = """
links AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges),
walk AS (SELECT rank AS seed, id AS start, id, 0 AS depth FROM hits WHERE rank <= 5
         UNION SELECT w.seed, w.start, l.b, w.depth + 1 FROM walk w JOIN links l ON l.a = w.id WHERE w.depth < {depth}),
near AS (SELECT seed, id, min(depth) AS depth FROM walk WHERE id <> start GROUP BY seed, id),
firsts AS (SELECT id, seed, depth FROM near WHERE id NOT IN (SELECT id FROM hits)
           QUALIFY row_number() OVER (PARTITION BY id ORDER BY seed, depth) = 1),
found AS (SELECT id, score, 0 AS is_neighbour, rank AS seed, 0 AS depth FROM hits
          UNION ALL SELECT f.id, h.score * power(0.5, f.depth), 1, f.seed, f.depth
          FROM firsts f JOIN hits h ON h.rank = f.seed WHERE f.id IN (SELECT id FROM nodes)),
final AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, is_neighbour, seed, depth, id)::INTEGER AS rank
          FROM found ORDER BY score DESC, is_neighbour, seed, depth, id LIMIT {k})"""
_RESULT = "SELECT rank, id, nodes.type, nodes.name, round(score, 6) AS score FROM final JOIN nodes USING (id)"


def _result(found: DataFrame) -> DataFrame:
    return found.select("rank", *_BRIEF, F.round("score", 6).alias("score"))


def _hybrid_oracle(k: int, depth: int) -> tuple[str, ...]:
    return (_HITS, _RANKED_HITS.format(k=k), _HYBRID.format(k=k, depth=depth))


@query(sql.graph("SELECT rank::INTEGER AS rank, id, round(score, 6) AS score FROM hits", _HITS, _RANKED_HITS.format(k=25)))
def j1_hits_with_nodes(spark, folder):
    g = table_graph.stored(spark, folder)
    hits = ranking.nearest(table_graph.embedded(spark, folder), _query_vector(spark, folder), 25)
    return hybrid.hits_with_nodes(hits, g.nodes, 25).select("rank", "id", F.round("score", 6).alias("score"))


@query(sql.graph(_RESULT, *_hybrid_oracle(10, 1)))
def i5_hybrid(spark, folder):
    g = table_graph.stored(spark, folder)
    hits = ranking.nearest(table_graph.embedded(spark, folder), _query_vector(spark, folder))
    return _result(hybrid.rank_hits(g.nodes, g.edges, hits))


@query(sql.graph(_RESULT, *_hybrid_oracle(40, 2)))
def i5_hybrid_two_steps(spark, folder):
    g = table_graph.stored(spark, folder)
    hits = ranking.nearest(table_graph.embedded(spark, folder), _query_vector(spark, folder), 40)
    return _result(hybrid.rank_hits(g.nodes, g.edges, hits, 40, depth=2))


@query(sql.graph("SELECT id, seed::INTEGER AS seed_rank, depth::INTEGER AS depth, "
                 "round(h.score * power(0.5, depth), 6) AS score FROM "
                 "(SELECT f.id, f.seed, f.depth FROM firsts f) JOIN hits h(hid, score, rank) ON rank = seed",
                 *_hybrid_oracle(10, 2)))
def t7_expanded_hits(spark, folder):
    g = table_graph.stored(spark, folder)
    hits = ranking.nearest(table_graph.embedded(spark, folder), _query_vector(spark, folder))
    hits = hybrid.hits_with_nodes(hits, g.nodes, 10)
    found = traversal.expand_hits(g.edges, hits, 2)
    return found.select("id", "seed_rank", "depth", F.round("score", 6).alias("score"))


@query(sql.graph(sql.context_of("final", "rank"), sql.BLOCKS, *_hybrid_oracle(40, 2)))
def k6_hybrid_context(spark, folder):
    g = table_graph.stored(spark, folder)
    hits = ranking.nearest(table_graph.embedded(spark, folder), _query_vector(spark, folder), 40)
    return ranking.pack_context(hybrid.rank_hits(g.nodes, g.edges, hits, 40, depth=2), F.col("rank"))


@query(sql.graph(sql.context_of("(SELECT id FROM nodes WHERE contains(lower(name), 'n_1')) q", "id"), sql.BLOCKS))
def k6_symbol_context(spark, folder):
    found = lookup.find_symbol(table_graph.stored(spark, folder).nodes, "n_1")
    return ranking.pack_context(found, F.col("id"))


# --- words -----------------------------------------------------------------------------------

_QUESTION = "the first of many words, an onthat and the other"
_WORDS = """
docs AS (SELECT 'func:' || doc_id AS id, 'function' AS type,
         list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS words FROM documents),
counted AS (SELECT id, word, count(*)::DOUBLE AS n FROM (SELECT id, unnest(words) AS word FROM docs) GROUP BY ALL),
lengths AS (SELECT id, sqrt(sum(n * n)) AS length FROM counted GROUP BY id),
asked AS (SELECT word, count(*)::DOUBLE AS n FROM (SELECT unnest(list_filter(string_split_regex(
          lower('{question}'), '[^a-z0-9]+'), lambda w: w <> '')) AS word) GROUP BY word),
matched AS (SELECT id, round(1 - sum(c.n * a.n) / any_value(l.length) / (SELECT sqrt(sum(n * n)) FROM asked), 12) AS distance
            FROM counted c JOIN asked a USING (word) JOIN lengths l USING (id) GROUP BY id),
raw AS (SELECT docs.id, type, coalesce(distance, 1.0) AS distance FROM docs LEFT JOIN matched USING (id))"""


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    # Spread: the table is a few files, and taking texts apart is work that their size does not show.
    return spread(_table(spark, folder, "documents"), "doc_id").select(
        F.concat(F.lit("func:"), F.col("doc_id").cast("string")).alias("id"),
        F.lit("function").alias("type"),
        F.col("text").alias("document"),
    )


@query("WITH " + _WORDS.format(question=_QUESTION)
       + " SELECT id, word, round(n / length, 6) AS weight FROM counted JOIN lengths USING (id)")
def k1_word_vectors(spark, folder):
    words = ranking.word_vectors(_documents(spark, folder))
    return words.select("id", "word", F.round("weight", 6).alias("weight"))


@query("WITH " + _WORDS.format(question=_QUESTION)
       + " SELECT row_number() OVER (ORDER BY distance, id)::INTEGER AS rank, id, round(distance, 6) AS distance "
       "FROM raw ORDER BY distance, id LIMIT 10")
def k1_nearest_by_words(spark, folder):
    docs = _documents(spark, folder)
    hits = ranking.nearest_by_words(ranking.word_vectors(docs), docs.select("id", "type"), _QUESTION)
    return hits.select("rank", "id", F.round("distance", 6).alias("distance"))


@query(sql.graph(_RESULT, _WORDS.format(question=_QUESTION),
                 _RANKED_HITS.format(k=10), _HYBRID.format(k=10, depth=1)))
def i5_hybrid_by_words(spark, folder):
    g = table_graph.stored(spark, folder)
    docs = _documents(spark, folder)
    hits = ranking.nearest_by_words(ranking.word_vectors(docs), docs.select("id", "type"), _QUESTION)
    return _result(hybrid.rank_hits(g.nodes, g.edges, hits))


# --- wording and scalar functions ------------------------------------------------------------


@query(
    sql.graph(
        """SELECT id, CASE type WHEN 'function' THEN concat_ws(' ', name, nullif(signature, ''), nullif(docstring, ''))
 WHEN 'class' THEN concat_ws(' ', name, nullif(docstring, '')) WHEN 'file' THEN name || ' ' || path ELSE name END
 AS document FROM nodes"""
    )
)
def x3_documents(spark, folder):
    return table_graph.stored(spark, folder).nodes.select("id", text.document().alias("document"))


@query(sql.graph("SELECT id, block FROM blocks", sql.BLOCKS))
def x4_context_blocks(spark, folder):
    return table_graph.stored(spark, folder).nodes.select("id", text.context_block().alias("block"))


@query(sql.graph("SELECT source_id, wanted AS type, name FROM open_refs"))
def x5_placeholders(spark, folder):
    target = F.col("target_id")
    return table_graph.stored(spark, folder).references.select(
        "source_id", paths.placeholder_type(target).alias("type"), paths.placeholder_name(target).alias("name")
    )


@query(
    "SELECT page_id, regexp_extract(url, '[^/]*$') AS last_part, lower(regexp_extract(regexp_extract(url, '[^/]*$'), "
    "'^.+(\\.[^.]+)$', 1)) AS suffix FROM pages"
)
def x7_last_part_and_suffix(spark, folder):
    url = F.col("url")
    return _table(spark, folder, "pages").select(
        "page_id", paths.last_part(url, "/").alias("last_part"), paths.suffix(url).alias("suffix")
    )


@query("SELECT event_id, props->>'$.k' AS k FROM events")
def x15_json_fields(spark, folder):
    fields = F.from_json("props", "map<string,string>")
    back = F.from_json(F.to_json(fields), "k string")
    return _table(spark, folder, "events").select("event_id", back["k"].alias("k"))


@query("SELECT o_orderkey, strftime(to_timestamp(epoch(o_orderdate)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS modified FROM orders")
def x16_mtime(spark, folder):
    seconds = F.unix_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    stamp = F.timestamp_seconds(seconds)
    return _table(spark, folder, "orders").select(
        "o_orderkey", F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("modified")
    )


@query(
    sql.graph(
        """SELECT '# Graph Statistics' || chr(10) || chr(10) || 'Total Nodes: ' ||
 ((SELECT count(*) FROM nodes) + (SELECT count(*) FROM undefined)) || chr(10) || 'Total Edges: ' || (SELECT count(*) FROM edges) || chr(10) || chr(10) ||
 '## Node Types:' || chr(10) || (SELECT string_agg('- ' || type || ': ' || n || chr(10), '' ORDER BY type)
   FROM (SELECT type, count(*) AS n FROM (SELECT type FROM nodes UNION ALL SELECT 'unknown' FROM undefined) GROUP BY type)) || chr(10) || '## Edge Types:' || chr(10) ||
 (SELECT string_agg('- ' || type || ': ' || n || chr(10), '' ORDER BY type)
   FROM (SELECT type, count(*) AS n FROM edges GROUP BY type)) AS text"""
    )
)
def x17_stats_text(spark, folder):
    g = table_graph.stored(spark, folder)
    return export.stats_text(g.nodes, g.edges)


@query(
    sql.graph(
        """SELECT '  "' || id || '" [label="' || type || '\\n' || name || '"];' AS line FROM nodes
UNION ALL SELECT '  "' || id || '" [label="unknown\\n' || id || '"];' FROM undefined
UNION ALL SELECT '  "' || source_id || '" -> "' || target_id || '" [label="' || type || '"];' FROM edges
UNION ALL SELECT unnest(['digraph CodeGraph {', '  rankdir=LR;', '  node [shape=box];', '}'])"""
    )
)
def s15_dot_lines(spark, folder):
    g = table_graph.stored(spark, folder)
    return export.dot_lines(g.nodes, g.edges).select("line")


# --- removals and upserts --------------------------------------------------------------------


@query(
    sql.graph(
        """SELECT 'nodes' AS part, type, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM gone) GROUP BY type
UNION ALL SELECT 'edges', type, count(*) FROM left_edges GROUP BY type
UNION ALL SELECT 'nodes', 'unknown', count(DISTINCT id) FROM (SELECT source_id AS id FROM left_edges UNION ALL SELECT target_id FROM left_edges)
 WHERE id NOT IN (SELECT id FROM nodes)""",
        "gone AS (SELECT id FROM nodes WHERE name = 'fn_5')",
        """left_edges AS (SELECT * FROM edges WHERE source_id NOT IN (SELECT id FROM gone)
 AND target_id NOT IN (SELECT id FROM gone))""",
    )
)
def u6_remove_nodes(spark, folder):
    g = table_graph.stored(spark, folder)
    nodes, edges = sets.without_nodes(g.nodes, g.edges, lookup.nodes_by_name(g.nodes, "fn_5"))
    return aggregates.type_counts(nodes, edges).select(F.concat("kind", F.lit("s")).alias("part"), "type", "n")


@query(
    sql.graph(
        """SELECT source_id, target_id, type FROM edges WHERE source_id NOT IN (SELECT id FROM gone)
 AND target_id NOT IN (SELECT id FROM gone)""",
        """gone AS (SELECT id FROM nodes WHERE coalesce(file_id, id) IN
  (SELECT id FROM nodes WHERE type = 'file' AND language = 'go'))""",
    )
)
def u5_edges_without_go_files(spark, folder):
    g = table_graph.stored(spark, folder)
    go_files = g.nodes.filter("type = 'file' AND language = 'go'").select(F.col("id").alias("file_id"))
    return sets.without_files(g.nodes, g.edges, go_files)[1].select("source_id", "target_id", "type")


@query(
    "SELECT p_name AS name, arg_max(p_partkey, (p_retailprice, p_partkey)) AS part, "
    "arg_max(p_brand, (p_retailprice, p_partkey)) AS brand FROM part GROUP BY p_name"
)
def a9_last_per_key(spark, folder):
    rows = _table(spark, folder, "part").select(
        F.col("p_name").alias("name"), F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"), "p_retailprice"
    )
    return sets.last_per_key(rows, ["name"], ["p_retailprice", "part"]).select("name", "part", "brand")


@query(
    "SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.last_event, a.last_event) AS last_event FROM "
    "(SELECT user_id, max(event_id) AS last_event FROM events WHERE event_type <> 'error' GROUP BY user_id) a FULL JOIN "
    "(SELECT user_id, max(event_id) AS last_event FROM events WHERE event_type = 'error' GROUP BY user_id) b "
    "ON a.user_id = b.user_id"
)
def s8_upsert(spark, folder):
    events = _table(spark, folder, "events")

    def last(rows: DataFrame) -> DataFrame:
        return rows.groupBy("user_id").agg(F.max("event_id").alias("last_event"))

    return sets.upsert(last(events.filter("event_type <> 'error'")), last(events.filter("event_type = 'error'")), ["user_id"])


# --- changes and events ----------------------------------------------------------------------

_CHANGE_PATH = "'src/u' || user_id || CASE event_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.txt' END"
_EVENT_KIND = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'moved' ELSE 'modified' END"
_MOVED_EVENTS = f"""
raw AS (SELECT event_id AS seq, ts, {_CHANGE_PATH} AS path, {_EVENT_KIND} AS event_type,
        'src/u' || user_id || '_new' || CASE event_id % 2 WHEN 0 THEN '.go' ELSE '.md' END AS dest_path,
        event_id % 11 = 0 AS is_directory FROM events),
kept AS (SELECT * FROM raw WHERE NOT is_directory),
split AS (SELECT seq, ts, path, event_type FROM kept WHERE event_type <> 'moved'
          UNION ALL SELECT seq, ts, path, 'deleted' FROM kept WHERE event_type = 'moved'
          UNION ALL SELECT seq, ts, dest_path, 'created' FROM kept WHERE event_type = 'moved'),
code AS (SELECT * FROM split WHERE path LIKE '%.py' OR path LIKE '%.ts' OR path LIKE '%.go')"""


def _file_events(spark: SparkSession, folder: str) -> DataFrame:
    return _as_file_events(_table(spark, folder, "events"))


def _event_path() -> Column:
    ending = F.get(F.array(F.lit(".py"), F.lit(".ts"), F.lit(".txt")), (F.col("event_id") % 3).cast("int"))
    return F.concat(F.lit("src/u"), F.col("user_id").cast("string"), ending)


def _as_file_events(events: DataFrame) -> DataFrame:
    number = F.col("user_id").cast("string")
    other = F.when(F.col("event_id") % 2 == 0, ".go").otherwise(".md")
    kind = (
        F.when(F.col("event_type") == "signup", "created")
        .when(F.col("event_type") == "error", "deleted")
        .when(F.col("event_type") == "purchase", "moved")
        .otherwise("modified")
    )
    return events.select(
        _event_path().alias("path"),
        F.concat(F.lit("src/u"), number, F.lit("_new"), other).alias("dest_path"),
        kind.alias("event_type"),
        (F.col("event_id") % 11 == 0).alias("is_directory"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


_CODE_SUFFIXES = [".py", ".ts", ".go"]


@query("WITH " + _MOVED_EVENTS + " SELECT seq, path, event_type FROM code")
def w4_code_events(spark, folder):
    return file_events.code_events(_file_events(spark, folder), _CODE_SUFFIXES).select("seq", "path", "event_type")


@query("WITH " + _MOVED_EVENTS + """ SELECT path, event_type, epoch_us(ts) AS at FROM (
 SELECT path, event_type, ts, lead(ts) OVER (PARTITION BY path ORDER BY ts) AS following FROM (
   SELECT path, ts, arg_max(event_type, seq) AS event_type FROM code GROUP BY path, ts))
 WHERE following IS NULL OR epoch_us(following) - epoch_us(ts) >= 7200000000::BIGINT""")
def w1_debounced_events(spark, folder):
    events = file_events.code_events(_file_events(spark, folder), _CODE_SUFFIXES)
    return file_events.debounce(events, 7200).select("path", "event_type", F.unix_micros("ts").alias("at"))


@query("WITH " + _MOVED_EVENTS + """ SELECT path, event_type, epoch_us(ts) AS at FROM (
 SELECT path, event_type, ts, lead(ts) OVER (PARTITION BY path ORDER BY ts) AS following FROM (
   SELECT path, ts, arg_max(event_type, seq) AS event_type FROM code GROUP BY path, ts))
 WHERE following IS NULL OR epoch_us(following) - epoch_us(ts) >= 7200000000::BIGINT""")
def w1_streamed_bursts(spark, folder):
    """The same bursts by a stream of micro-batches; those still open at its end are settled then."""
    rows = spark.readStream.schema(_table(spark, folder, "events").schema).option("pathGlobFilter", "events.parquet")
    events = file_events.code_events(_as_file_events(rows.parquet(folder)), _CODE_SUFFIXES)
    base = f"{work_folder(spark)}/bursts-{uuid.uuid4().hex}"
    settler = file_events.BurstSettler(spark, 7200)

    def apply(batch, number):
        settler.settle(batch, time.time()).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    writer = events.writeStream.outputMode("append").foreachBatch(apply)
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    settler.settle(None, None).write.parquet(f"{base}/out/batch=-1")
    return spark.read.parquet(f"{base}/out").select("path", "event_type", F.unix_micros("ts").alias("at"))


_CHANGES = f"""
listed AS (SELECT event_id, {_CHANGE_PATH} AS path, 'src/old' || user_id || '.py' AS former,
           CASE event_type WHEN 'signup' THEN 'A' WHEN 'error' THEN 'D' WHEN 'purchase' THEN 'R' WHEN 'view' THEN 'T'
                ELSE 'M' END AS status FROM events WHERE event_id % 4 <> 0),
loose AS (SELECT DISTINCT {_CHANGE_PATH} AS path FROM events WHERE event_id % 4 = 0),
changes AS (SELECT path, status, CASE WHEN status = 'R' THEN former END AS old_path FROM listed),
pending AS (SELECT * FROM changes UNION ALL
            SELECT path, 'A', NULL FROM loose WHERE path NOT IN (SELECT path FROM changes))"""


def _status_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, path, line): a status line, as git prints it, for each event."""
    events = _table(spark, folder, "events").withColumn("path", _event_path())
    former = F.concat(F.lit("src/old"), F.col("user_id").cast("string"), F.lit(".py"))
    letter = (
        F.when(F.col("event_type") == "signup", "A")
        .when(F.col("event_type") == "error", "D")
        .when(F.col("event_type") == "view", "T")
        .otherwise("M")
    )
    line = F.when(F.col("event_type") == "purchase", F.concat_ws("\t", F.lit("R087"), former, "path")).otherwise(
        F.concat_ws("\t", letter, F.col("path"))
    )
    return events.select(F.col("event_id").alias("seq"), "path", line.alias("line"))


def _changes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged and unstaged changes and untracked paths; status lines are parsed as git prints them."""
    lines = _status_lines(spark, folder)
    staged = changes.parse_name_status(lines.filter("seq % 4 = 1"))
    unstaged = changes.parse_name_status(lines.filter("seq % 4 > 1"))
    untracked = lines.filter("seq % 4 = 0").select("path").distinct()
    return staged, unstaged, untracked


@query("WITH " + _CHANGES.replace(" WHERE event_id % 4 <> 0", "") + " SELECT path, status, old_path FROM changes")
def s13_parsed_status_lines(spark, folder):
    return changes.parse_name_status(_status_lines(spark, folder))


@query("WITH " + _CHANGES + " SELECT path, status, old_path FROM pending")
def j7_pending_changes(spark, folder):
    return changes.pending_changes(*_changes(spark, folder))


@query("WITH " + _CHANGES + """ SELECT 'remove' AS action, path FROM (SELECT path FROM pending WHERE status = 'D'
 UNION SELECT old_path FROM pending WHERE status = 'R') UNION ALL
 SELECT DISTINCT 'index', path FROM pending WHERE status IN ('A', 'M', 'R')""")
def j11_change_plan(spark, folder):
    pending = changes.pending_changes(*_changes(spark, folder))
    removed = changes.removed_paths(pending).select(F.lit("remove").alias("action"), "path")
    return removed.unionByName(changes.paths_to_index(pending).select(F.lit("index").alias("action"), "path"))


@query("WITH " + _CHANGES + """ SELECT count(*) FILTER (WHERE ok AND status = 'A') AS files_added,
 count(*) FILTER (WHERE ok AND status IN ('M', 'R')) AS files_modified, count(*) FILTER (WHERE status = 'D') AS files_deleted,
 coalesce(sum(CASE WHEN ok AND status IN ('A', 'M', 'R') THEN length(path) % 2 END), 0)::BIGINT AS errors
 FROM (SELECT *, path LIKE '%.py' OR path LIKE '%.ts' AS ok FROM pending)""")
def a4_change_counts(spark, folder):
    pending = changes.pending_changes(*_changes(spark, folder))
    parsed = pending.select("path").distinct().filter(paths.has_suffix(F.col("path"), [".py", ".ts"]))
    return changes.change_counts(pending, parsed.withColumn("errors", F.length("path") % 2))


_SCAN_PATH = """CASE doc_id % 4 WHEN 0 THEN source || '/node_modules' WHEN 1 THEN 'build' || '/' || source
 WHEN 2 THEN source || '/builds' ELSE source || '/x.egg-info' END || '/__init__' || CASE doc_id % 6 WHEN 0 THEN '.PY'
 WHEN 1 THEN '.tsx' WHEN 2 THEN '.mjs' WHEN 3 THEN '.h' WHEN 4 THEN '.go' ELSE '' END"""


@query(f"""SELECT doc_id, path, CASE doc_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 3 THEN 'c' WHEN 4 THEN 'go'
 ELSE 'unknown' END AS language FROM (SELECT doc_id, {_SCAN_PATH} AS path FROM documents)
 WHERE doc_id % 4 > 1 AND doc_id % 6 <> 5""")
def s2_scanned_paths(spark, folder):
    four = F.array(
        F.concat("source", F.lit("/node_modules")),
        F.concat(F.lit("build/"), "source"),
        F.concat("source", F.lit("/builds")),
        F.concat("source", F.lit("/x.egg-info")),
    )
    ends = F.array(*[F.lit(s) for s in (".PY", ".tsx", ".mjs", ".h", ".go", "")])
    path = F.concat(
        F.get(four, (F.col("doc_id") % 4).cast("int")),
        F.lit("/__init__"),
        F.get(ends, (F.col("doc_id") % 6).cast("int")),
    )
    rows = _table(spark, folder, "documents").select("doc_id", path.alias("path"))
    wanted = ~paths.ignored(F.col("path")) & paths.has_suffix(F.col("path"), [".py", ".tsx", ".mjs", ".h", ".go"])
    return rows.filter(wanted).withColumn("language", paths.language(F.col("path")))
