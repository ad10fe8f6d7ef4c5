"""DuckDB twins of the registered queries, over the same parquet tables."""

from __future__ import annotations

GRAPH = """
file_rows AS (
  SELECT n_nationkey AS nation, n_regionkey AS region,
         lower(n_name) || CASE n_nationkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.js'
                                               WHEN 3 THEN '.go' ELSE '.rs' END AS name,
         CASE n_nationkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript'
                              WHEN 3 THEN 'go' ELSE 'rust' END AS language
  FROM nation),
fileset AS (SELECT nation, region, name, language, 'src/' || name AS path, 'file:src/' || name AS id FROM file_rows),
cust AS (SELECT c_custkey, c_mktsegment, f.id AS file_id FROM customer JOIN fileset f ON c_nationkey = f.nation),
ord AS (SELECT o.*, cust.file_id FROM orders o JOIN cust ON o_custkey = c_custkey),
supp AS (SELECT s_suppkey, f.id AS file_id, 'region_' || f.region AS module
         FROM supplier JOIN fileset f ON s_nationkey = f.nation),
nodes AS (
  SELECT id, 'file' AS type, name, NULL::VARCHAR AS file_id, NULL::VARCHAR AS class_id, path, language,
         NULL::VARCHAR AS signature, NULL::VARCHAR AS docstring, NULL::INTEGER AS start_line,
         NULL::INTEGER AS end_line, NULL::BOOLEAN AS is_async, NULL::BOOLEAN AS is_method,
         NULL::VARCHAR AS base, NULL::VARCHAR AS module, NULL::INTEGER AS line, NULL::VARCHAR AS type_hint,
         NULL::BIGINT AS ord
  FROM fileset
  UNION ALL BY NAME
  SELECT 'class:' || c_custkey AS id, 'class' AS type, 'Class_' || (c_custkey % 500) AS name, file_id,
         c_mktsegment AS docstring, (c_custkey % 100 + 1)::INTEGER AS start_line,
         (c_custkey % 100 + 11)::INTEGER AS end_line,
         CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS base, c_custkey AS ord
  FROM cust
  UNION ALL BY NAME
  SELECT 'func:' || o_orderkey AS id, 'function' AS type, 'fn_' || (o_orderkey % 1000) AS name, file_id,
         CASE WHEN o_orderkey % 10 <> 0 THEN 'class:' || o_custkey END AS class_id,
         CASE WHEN o_orderkey % 7 = 0 THEN ''
              ELSE 'def fn_' || (o_orderkey % 1000) || '(' || o_orderstatus || ')' END AS signature,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS docstring,
         (o_orderkey % 1000 + 1)::INTEGER AS start_line,
         (o_orderkey % 1000 + 1 + o_orderkey % 50)::INTEGER AS end_line,
         o_orderkey % 4 = 0 AS is_async, o_orderkey % 10 <> 0 AS is_method, o_orderkey AS ord
  FROM ord
  UNION ALL BY NAME
  SELECT 'import:' || s_suppkey AS id, 'import' AS type, module AS name, file_id, module,
         (s_suppkey % 50 + 1)::INTEGER AS line
  FROM supp
  UNION ALL BY NAME
  SELECT 'var:' || p_partkey AS id, 'variable' AS type, p_name AS name, f.id AS file_id, p_brand AS type_hint,
         p_size AS line
  FROM part JOIN fileset f ON p_partkey % 25 = f.nation),
edges AS (
  SELECT file_id AS source_id, 'class:' || c_custkey AS target_id, 'defines' AS type, 0 AS ord FROM cust
  UNION ALL SELECT file_id, 'func:' || o_orderkey, 'defines', 0 FROM ord WHERE o_orderkey % 10 = 0
  UNION ALL SELECT 'class:' || o_custkey, 'func:' || o_orderkey, 'contains', 0 FROM ord WHERE o_orderkey % 10 <> 0
  UNION ALL SELECT file_id, 'import:' || s_suppkey, 'imports', 0 FROM supp
  UNION ALL SELECT 'class:' || c_custkey, 'class:' || (c_custkey // 2), 'inherits', 0 FROM cust WHERE c_custkey > 0
  UNION ALL SELECT 'class:' || c_custkey, 'class:' || (c_custkey - 1), 'inherits', 1 FROM cust WHERE c_custkey % 10 = 3
  UNION ALL SELECT 'func:' || o_orderkey, 'func:' || o_custkey, 'calls', 0 FROM ord WHERE o_orderkey <> o_custkey
  UNION ALL SELECT DISTINCT 'func:' || l_orderkey, 'var:' || l_partkey, 'uses', 0 FROM lineitem
  UNION ALL SELECT 'func:' || o_orderkey, 'func:gone_' || (o_orderkey % 7), 'calls', 0 FROM ord WHERE o_orderkey % 50 = 1
  UNION ALL SELECT 'func:' || o_orderkey, 'func:' || o_custkey, 'uses', 0 FROM ord WHERE o_orderkey % 20 = 2
  UNION ALL SELECT 'func:' || o_orderkey, 'func:' || o_orderkey, 'uses', 0 FROM ord WHERE o_orderkey % 40 = 3
  UNION ALL SELECT 'func:' || o_custkey, 'func:' || o_orderkey, 'uses', 0 FROM ord WHERE o_orderkey % 60 = 7
  UNION ALL SELECT 'class:' || c_custkey, 'class:1', 'inherits', 2 FROM cust WHERE c_custkey = 0),
undefined AS (SELECT DISTINCT id FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges)
              WHERE id NOT IN (SELECT id FROM nodes)),
open_refs AS (
  SELECT 'func:' || o_orderkey AS source_id, 'func:*:*:fn_' || (o_orderkey * 7 % 1500) AS target_id,
         'calls' AS type, 'function' AS wanted, 'fn_' || (o_orderkey * 7 % 1500) AS name FROM ord
  UNION ALL
  SELECT 'class:' || c_custkey, 'class:*:Class_' || (c_custkey * 3 % 800), 'inherits', 'class',
         'Class_' || (c_custkey * 3 % 800) FROM cust),
vecs AS (
  SELECT CASE WHEN vec_id % 3 = 0 THEN 'class:' || vec_id ELSE 'func:' || vec_id END AS id,
         CASE WHEN vec_id % 3 = 0 THEN 'class' ELSE 'function' END AS type, embedding
  FROM embeddings)
"""

# Context blocks, one per node.
BLOCKS = """
blocks AS (
  SELECT id, CASE type
    WHEN 'function' THEN concat_ws(chr(10), '# FUNCTION: ' || name, 'Signature: ' || coalesce(signature, ''),
        'File: ' || file_id, 'Lines: ' || start_line || '-' || end_line, 'Docstring: ' || nullif(docstring, ''))
    WHEN 'class' THEN concat_ws(chr(10), '# CLASS: ' || name, 'File: ' || file_id, 'Bases: ' || base,
        'Docstring: ' || nullif(docstring, ''))
    WHEN 'file' THEN concat_ws(chr(10), '# FILE: ' || name, 'Path: ' || path, 'Language: ' || language)
    ELSE '# ' || upper(type) || ': ' || name END AS block
  FROM nodes)
"""


def graph(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([GRAPH, *more]) + "\n" + body


def undirected() -> str:
    return (
        "links AS (SELECT source_id AS a, target_id AS b FROM edges "
        "UNION SELECT target_id, source_id FROM edges)"
    )


def walk(start: str, depth: int | None, a: str, b: str, kind: str | None, table: str = "edges") -> str:
    """Distinct (id, depth) rows of walks from `start`, to be reduced by min(depth)."""
    where = f" AND e.type = '{kind}'" if kind else ""
    if depth is None:
        return (
            f"walk AS (SELECT '{start}' AS id UNION SELECT e.{b} FROM walk w JOIN {table} e ON e.{a} = w.id{where})"
        )
    return (
        f"walk AS (SELECT '{start}' AS id, 0 AS depth UNION SELECT e.{b}, w.depth + 1 FROM walk w "
        f"JOIN {table} e ON e.{a} = w.id{where} WHERE w.depth < {depth})"
    )


def reached(start: str) -> str:
    return f"reached AS (SELECT id, min(depth)::INTEGER AS depth FROM walk WHERE id <> '{start}' GROUP BY id)"


def context_of(rows: str, order: str, limit: int = 4000) -> str:
    """Context of `rows` (a relation with ids) in an order."""
    return f"""
SELECT string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context
FROM (SELECT rank, block, sum(length(block)) OVER (ORDER BY rank) AS total
      FROM (SELECT block, row_number() OVER (ORDER BY {order}) AS rank FROM {rows} JOIN blocks USING (id)))
WHERE total <= {limit}"""


def pagerank(steps: int, alpha: float = 0.85) -> str:
    """`steps` unrolled iterations over the simple graph as CTEs r0 .. r<steps>."""
    parts = [
        "pairs AS MATERIALIZED (SELECT DISTINCT source_id AS s, target_id AS t FROM edges)",
        "verts AS MATERIALIZED (SELECT id FROM nodes UNION SELECT s FROM pairs UNION SELECT t FROM pairs)",
        "deg AS MATERIALIZED (SELECT s, count(*) AS d FROM pairs GROUP BY s)",
        "size AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM verts)",
        "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank, 1e9::DOUBLE AS before FROM verts, size)",
    ]
    for i in range(1, steps + 1):
        parts.append(
            f"g{i} AS MATERIALIZED (SELECT t AS id, sum(rank / d) AS part FROM pairs JOIN deg USING (s) "
            f"JOIN r{i - 1} r ON r.id = pairs.s GROUP BY t)"
        )
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT r.id, (1 - {alpha}) / n + {alpha} * "
            f"(coalesce(part, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} "
            f"WHERE id NOT IN (SELECT s FROM deg)) / n) AS rank, r.rank AS before "
            f"FROM r{i - 1} r LEFT JOIN g{i} USING (id), size)"
        )
    return ",\n".join(parts)


def settled(steps: int, tolerance: float = 1e-6) -> str:
    """The first of `steps` iterations whose change is below the tolerance."""
    change = " UNION ALL ".join(
        f"SELECT {i} AS i, sum(abs(rank - before)) AS moved FROM r{i}" for i in range(1, steps + 1)
    )
    ranks = " UNION ALL ".join(f"SELECT {i} AS i, id, rank FROM r{i}" for i in range(1, steps + 1))
    return (
        f"moves AS ({change}), "
        f"stop AS (SELECT min(i) AS i FROM moves, size WHERE moved < n * {tolerance}), "
        f"final AS (SELECT id, rank FROM ({ranks}) JOIN stop USING (i))"
    )
