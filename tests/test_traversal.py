from collections import deque

import pytest
from conftest import edge_frame, node_frame
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeskein.operators import aggregates, lookup, ranking, traversal
from codeskein.plans import hybrid

METHOD, HELPER = "func:test.py:MyClass:method", "func:test.py:module:helper"
CLASS, FILE = "class:test.py:MyClass", "file:test.py"


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


def depths(df):
    return {r["id"]: r["depth"] for r in df.select("id", "depth").collect()}


def test_related(small_graph):
    assert depths(traversal.related(*small_graph, METHOD, 1)) == {CLASS: 1, HELPER: 1}
    assert depths(traversal.related(*small_graph, METHOD, 2)) == {CLASS: 1, HELPER: 1, FILE: 2}
    assert depths(traversal.related(*small_graph, METHOD, 2, ["calls"])) == {HELPER: 1}
    assert ids(traversal.related(*small_graph, "no such id", 2)) == set()
    assert ids(traversal.related(*small_graph, METHOD, 0)) == set()


def test_callers_and_callees(small_graph):
    assert ids(traversal.callers(*small_graph, HELPER)) == {METHOD}
    assert ids(traversal.callees(*small_graph, METHOD)) == {HELPER}


def test_file_symbols(small_graph):
    found = lookup.file_symbols(*small_graph, FILE)
    assert {(r["bucket"], r["name"]) for r in found.collect()} == {("classes", "MyClass"), ("functions", "helper")}


def test_complexity(small_graph):
    nodes, edges = small_graph
    assert {r["complexity"] for r in aggregates.complexity(nodes, edges).collect()} == {1.0}
    assert aggregates.complexity_of(edges, METHOD).first()["complexity"] == 1.0
    assert aggregates.complexity_of(edges, "nothing").first()["complexity"] == 0.0


def test_complexity_counts_a_loop_twice_and_a_pair_once(spark):
    nodes = node_frame(spark, [{"id": i, "type": "function", "name": i} for i in "ab"])
    edges = edge_frame(spark, [("a", "a", "calls"), ("a", "b", "calls"), ("a", "b", "uses")])
    found = {r["id"]: r["complexity"] for r in aggregates.complexity(nodes, edges).collect()}
    assert found == {"a": 1.5, "b": 0.5}
    assert aggregates.complexity_of(edges, "a").first()["complexity"] == 1.5


def _chain(spark, closed: bool):
    nodes = node_frame(spark, [{"id": f"f{i}", "type": "function", "name": f"f{i}"} for i in range(7)])
    links = [(f"f{i}", f"f{i + 1}", "calls") for i in range(6)] + ([("f6", "f0", "calls")] if closed else [])
    return nodes, edge_frame(spark, links)


def test_depth_bounds_differ(spark):
    graph = _chain(spark, closed=False)
    assert ids(traversal.callees(*graph, "f0", 3)) == {"f1", "f2", "f3", "f4"}
    assert ids(traversal.related(*graph, "f0", 3)) == {"f1", "f2", "f3"}


def test_cycles_end(spark):
    graph = _chain(spark, closed=True)
    assert ids(traversal.callees(*graph, "f0", 3)) == {"f1", "f2", "f3", "f4"}
    found = depths(traversal.related(*graph, "f0", 3))
    assert found == {"f1": 1, "f2": 2, "f3": 3, "f4": 3, "f5": 2, "f6": 1}
    assert len(ids(traversal.callees(*graph, "f0", 50))) == 6


def _classes(spark, *more):
    nodes = node_frame(spark, [{"id": c, "type": "class", "name": c} for c in "ABCD"])
    links = [("B", "A", "inherits"), ("C", "B", "inherits"), ("D", "A", "inherits", 0), ("D", "C", "inherits", 1)]
    return nodes, edge_frame(spark, links + list(more))


def test_inheritance(spark):
    graph = _classes(spark)
    chain = traversal.inheritance_chain(*graph, "C").orderBy("depth").collect()
    assert [r["id"] for r in chain] == ["B", "A"]
    assert ids(traversal.inheritance_chain(*graph, "D")) == {"A"}
    assert ids(traversal.subclasses(*graph, "A")) == {"B", "C", "D"}
    assert ids(traversal.subclasses(*graph, "A", recursive=False)) == {"B", "D"}


def test_inheritance_cycle_ends(spark):
    graph = _classes(spark, ("A", "C", "inherits"))
    assert ids(traversal.inheritance_chain(*graph, "C")) == {"B", "A"}
    assert ids(traversal.subclasses(*graph, "A")) == {"B", "C", "D"}


def test_references(spark, small_graph):
    assert ids(traversal.references(*small_graph, HELPER)) == {METHOD}
    assert ids(traversal.references(*small_graph, FILE)) == set()
    assert ids(traversal.references(*small_graph, "nothing")) == set()
    found = traversal.references(*_classes(spark), "A", 2).collect()
    assert [(r["id"], r["score"]) for r in found] == [("B", 0.8), ("D", 0.8)]


def _python_bfs(links, start, depth):
    seen, queue = {start: 0}, deque([start])
    while queue:
        here = queue.popleft()
        if seen[here] < depth:
            for a, b in links:
                for near, far in ((a, b), (b, a)):
                    if near == here and far not in seen:
                        seen[far] = seen[here] + 1
                        queue.append(far)
    return {k: v for k, v in seen.items() if k != start}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=25), st.integers(1, 4))
def test_related_equals_a_plain_search(spark, links, depth):
    links = [(f"n{a}", f"n{b}") for a, b in set(links)]
    nodes = node_frame(spark, [{"id": f"n{i}", "type": "function", "name": "x"} for i in range(10)])
    edges = edge_frame(spark, [(a, b, "calls") for a, b in links])
    assert depths(traversal.related(nodes, edges, "n0", depth)) == _python_bfs(links, "n0", depth)


def _python_pagerank(names, links, alpha=0.85, steps=100, tolerance=1e-6):
    n, links = len(names), set(links)
    out = {v: [b for a, b in links if a == v] for v in names}
    x = dict.fromkeys(names, 1 / n)
    for _ in range(steps):
        loose = sum(x[v] for v in names if not out[v])
        y = dict.fromkeys(names, (1 - alpha + alpha * loose) / n)
        for v in names:
            for w in out[v]:
                y[w] += alpha * x[v] / len(out[v])
        if sum(abs(y[v] - x[v]) for v in names) < n * tolerance:
            return y
        x = y
    raise AssertionError


@pytest.mark.parametrize("links_per_slot", [2, 1000])
def test_pagerank(spark, links_per_slot):
    names = [f"v{i}" for i in range(8)]
    pairs = [(0, i) for i in range(1, 8)] + [(1, 2), (2, 3), (3, 1), (4, 0), (5, 0), (5, 5)]
    links = [(f"v{a}", f"v{b}") for a, b in pairs]
    nodes = node_frame(spark, [{"id": v, "type": "function", "name": v} for v in names[:7]])  # v7 is undefined
    edges = edge_frame(spark, [(a, b, "calls") for a, b in links] + [("v1", "v2", "uses")])
    ranks = aggregates.pagerank(nodes, edges, links_per_slot=links_per_slot)
    found = {r["id"]: r["rank"] for r in ranks.collect()}
    wanted = _python_pagerank(names, links)
    assert found.keys() == wanted.keys()
    assert all(abs(found[v] - wanted[v]) < 1e-12 for v in names)


def test_pagerank_reports_no_convergence_and_takes_an_empty_graph(spark, small_graph):
    with pytest.raises(aggregates.NotConverged):
        aggregates.pagerank(*small_graph, max_iterations=1)
    empty = small_graph[0].filter("false"), small_graph[1].filter("false")
    assert aggregates.central_nodes(*empty).count() == 0


def _hits(spark, rows):
    return spark.createDataFrame(rows, "rank int, id string, distance double")


def test_hybrid_scores_and_order(spark, small_graph):
    hits = _hits(spark, [(1, METHOD, 0.2), (2, HELPER, 0.5)])
    rows = hybrid.rank_hits(*small_graph, hits).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [METHOD, HELPER, CLASS, FILE]
    assert [round(r["score"], 6) for r in rows] == [0.8, 0.5, 0.4, 0.25]
    rows = hybrid.rank_hits(*small_graph, hits, max_results=3).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [METHOD, HELPER, CLASS]


def test_hybrid_drops_hits_without_a_node_and_may_filter_neighbours(spark, small_graph):
    hits = _hits(spark, [(1, "gone", 0.1), (2, METHOD, None)])
    rows = hybrid.rank_hits(*small_graph, hits, expand=False).collect()
    assert [(r["id"], r["score"], r["rank"]) for r in rows] == [(METHOD, 1.0, 1)]
    near = hybrid.rank_hits(*small_graph, hits, node_types=("function",), filter_neighbours=True)
    assert ids(near) == {METHOD, HELPER}


def test_context_stops_at_the_first_overflow(spark):
    names = ["a" * 10, "b" * 3000, "c" * 1000, "d"]
    nodes = node_frame(spark, [{"id": str(i), "type": "import", "name": n} for i, n in enumerate(names)])
    context = ranking.pack_context(nodes, F.col("id")).first()["context"]
    # The third would pass 4000 characters; the fourth would fit but comes after it.
    assert context == f"# IMPORT: {'a' * 10}\n\n# IMPORT: {'b' * 3000}"
    assert ranking.pack_context(nodes.filter("false"), F.col("id")).first()["context"] == ""


def test_search_by_words_fills_up_with_unrelated_documents(spark):
    rows = [("d1", "function", "red green"), ("d2", "class", "red"), ("d3", "function", "blue"), ("d4", "file", "")]
    docs = spark.createDataFrame(rows, "id string, type string, document string")
    words, listed = ranking.word_vectors(docs), docs.select("id", "type")
    found = ranking.nearest_by_words(words, listed, "Red!", 3).orderBy("rank").collect()
    assert [(r["id"], round(r["distance"], 6)) for r in found] == [("d2", 0.0), ("d1", 0.292893), ("d3", 1.0)]
    only = ranking.nearest_by_words(words, listed, "red", 9, ["function"]).orderBy("rank").collect()
    assert [r["id"] for r in only] == ["d1", "d3"]
    assert ranking.nearest_by_words(words, listed, "?", 9).count() == 4


def test_the_first_hit_owns_a_neighbour_and_nothing_is_sorted_for_it(spark):
    edges = edge_frame(spark, [("a", "m", "calls"), ("m", "x", "calls"), ("b", "x", "calls"), ("b", "y", "calls")])
    hits = spark.createDataFrame([("a", 1, 0.8), ("b", 2, 0.4)], "id string, rank int, score double")
    found = traversal.expand_hits(edges, hits, 2)
    assert found.schema["seed_rank"].dataType.simpleString() == "int"
    rows = {r["id"]: (r["seed_rank"], r["depth"], r["score"]) for r in found.collect()}
    assert rows == {"m": (1, 1, 0.4), "x": (1, 2, 0.2), "y": (2, 1, 0.2)}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
