"""Nothing is dropped where a bound, a failing helper or a large number used to do so."""

import subprocess

import pytest
from conftest import edge_frame, node_frame
from pyspark.sql import functions as F

from codeskein.sources import repo_files
from codeskein import CodeIndexer, GraphStore, cli
from codeskein.operators import lookup, ranking, traversal
from codeskein.parsing import go_reader, script_reader
from codeskein.plans import hybrid, table_graph
from codeskein.schema import EDGES, NODES, conform
from codeskein.sources.git import GitError, GitTracker


def git(tree, *args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=tree, check=True, capture_output=True)


def test_a_long_comment_before_a_type_brace():
    pad = "/* " + "long comment " * 10 + "*/"
    rows = script_reader.read(f"function f(): {pad} {{ a: number }} {{\n  return 1;\n}}\n", "")
    [f] = [r for r in rows if r["kind"] == "function"]
    assert f["end_line"] == 3
    rows = go_reader.read(f"package p\nfunc F() struct {pad} {{ A int }} {{\n\treturn 1\n}}\n", "")
    [f] = [r for r in rows if r["kind"] == "function"]
    assert f["end_line"] == 4


def test_context_of_many_short_blocks(spark):
    rows = [{"id": f"{i:04}", "type": "x", "name": "a" if i % 7 else None} for i in range(1500)]
    context = ranking.pack_context(node_frame(spark, rows), F.col("id"), max_length=6 * 700).first()["context"]
    assert context.count("# X: a") == 700


def test_predicates_see_all_fields(spark, small_graph):
    nodes, _ = small_graph
    rows = lookup.search_nodes(nodes, lambda n: n["signature"] == "" and n["start_line"] > 10)
    assert [r["id"] for r in rows.collect()] == ["func:test.py:module:helper"]
    rows = lookup.search_nodes(nodes, lambda t: t["end_line"] == 20, columns=["end_line"], vectorized=True)
    assert [r["name"] for r in rows.collect()] == ["MyClass"]


def test_positions_above_32_bits(spark):
    big = 1 << 40
    edges = conform(spark.createDataFrame([("a", "c", "inherits", big + 1), ("a", "b", "inherits", big)], "source_id string, target_id string, type string, ord long"), EDGES)
    nodes = node_frame(spark, [{"id": i, "type": "class", "name": i, "ord": big} for i in "abc"])
    assert [r["id"] for r in traversal.inheritance_chain(nodes, edges, "a").collect()] == ["b"]
    assert NODES["ord"].dataType == EDGES["ord"].dataType


@pytest.mark.parametrize("loop", [False, True])
def test_long_chains_and_cycles(spark, loop):
    n = 1000
    links = [(f"c{i}", f"c{i + 1}", "inherits") for i in range(n)] + ([(f"c{n}", "c10", "inherits")] if loop else [])
    nodes = node_frame(spark, [{"id": f"c{i}", "type": "class", "name": str(i)} for i in range(n + 1)])
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"chain{loop}", "chain")
    found = traversal.inheritance_chain(nodes, edge_frame(spark, links), "c0").orderBy("depth").collect()
    count = len(jobs.getJobIdsForGroup(f"chain{loop}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r["id"] for r in found] == [f"c{i}" for i in range(1, n + 1)]
    assert count < 160  # about ten rounds, not a thousand


def test_hits_are_joined_without_moving_the_nodes(spark, small_graph, tmp_path):
    nodes, _ = small_graph
    nodes.write.parquet(str(tmp_path / "nodes"))
    hits = spark.createDataFrame([("class:test.py:MyClass", 0.1, 1), ("gone", 0.2, 2)], "id string, distance double, rank int")
    hits.write.parquet(str(tmp_path / "hits"))
    stored, hits = (spark.read.parquet(str(tmp_path / n)) for n in ("nodes", "hits"))
    size = sum(p.stat().st_size for p in (tmp_path / "hits").iterdir())
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(2 * size))
    try:
        found = hybrid.hits_with_nodes(hits, stored, 10)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        physical = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "LeftSemi" not in plan and "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical
    assert [r["id"] for r in found.collect()] == ["class:test.py:MyClass"]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("def one(): pass\n")
    git(root, "init", "-q")
    git(root, "add", ".")
    git(root, "commit", "-qm", "first")
    return root


def names(store):
    return {r["name"] for r in store.get_nodes_by_type("function").collect()}


def test_commits_between_runs_are_indexed(spark, tree):
    store = GraphStore(spark, str(tree.parent / "graph"))
    indexer = CodeIndexer(str(tree), store)
    assert indexer.index_incremental()["functions"] == 1  # nothing known yet: in full
    (tree / "b.py").write_text("def two(): pass\n")
    git(tree, "add", ".")
    git(tree, "commit", "-qm", "second")
    (tree / "c\td\"é.py").write_text("def three(): pass\n")
    indexer.index_incremental()
    assert names(store) == {"one", "two", "three"}
    git(tree, "add", ".")
    git(tree, "commit", "-qm", "third")
    (tree / "a.py").write_text("def four(): pass\n")
    indexer.index_incremental()
    assert names(store) == {"four", "two", "three"}


def test_command_line_indexes_commits(spark, tree, capsys):
    cli.main(["-r", str(tree), "index", "--no-vectors"])
    (tree / "b.py").write_text("def two(): pass\n")
    git(tree, "add", "b.py")
    git(tree, "commit", "-qm", "second")
    cli.main(["-r", str(tree), "index", "--no-vectors"])
    capsys.readouterr()
    cli.main(["-r", str(tree), "find", "two"])
    assert "FUNCTION: two" in capsys.readouterr().out


def test_failures_of_git_are_errors_and_do_not_move_the_mark(spark, tree, monkeypatch):
    tracker = GitTracker(spark, str(tree))
    with pytest.raises(GitError):
        tracker.get_changes_since("0" * 40)
    indexer = CodeIndexer(str(tree), GraphStore(spark, str(tree.parent / "graph")))
    indexer.index_full()
    mark = indexer.last_commit()
    (tree / "b.py").write_text("def two(): pass\n")
    git(tree, "add", ".")
    git(tree, "commit", "-qm", "second")

    def fails(*args):
        raise GitError("no answer")

    monkeypatch.setattr(indexer.git, "get_untracked_files", fails)
    with pytest.raises(GitError):
        indexer.index_incremental()
    assert indexer.last_commit() == mark
    monkeypatch.undo()
    indexer.index_incremental()
    assert names(indexer.store) == {"one", "two"} and indexer.last_commit() != mark


def test_an_unknown_commit_means_everything(spark, tree):
    indexer = CodeIndexer(str(tree), GraphStore(spark))
    assert indexer.index_incremental(since_commit="0" * 40)["functions"] == 1


def test_unreadable_folders_and_failing_git_are_errors(spark, tmp_path, monkeypatch):
    walk = repo_files.TreeWalk({"path": str(tmp_path)})
    assert list(walk._entries(str(tmp_path / "gone"))) == []
    with pytest.raises(FileNotFoundError):
        repo_files.TreeWalk({"path": str(tmp_path / "gone")}).split()

    def refuses(folder):
        raise PermissionError(folder)

    monkeypatch.setattr(repo_files.os, "scandir", refuses)
    with pytest.raises(PermissionError):
        walk.split()
    monkeypatch.undo()
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / ".git").write_text("nothing that git knows")
    with pytest.raises(Exception, match="check-ignore"):
        repo_files.scan(spark, str(tmp_path), [".py"]).collect()


def test_a_file_that_has_gone_is_not_read(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "d.py").mkdir()
    paths = spark.createDataFrame([("a.py",), ("gone.py",), ("d.py",), ("a.py/b.py",)], "path string")
    assert [r["path"] for r in repo_files.read_contents(paths, str(tmp_path)).collect()] == ["a.py"]


def test_orders_and_customers_of_the_table_graph_are_not_broadcast(spark, tmp_path):
    """Tables of a few rows, which the planner would send through the driver; their graph has all of them."""
    tables = {
        "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "ALGERIA", 0), (1, "BRAZIL", 1)]),
        "customer": ("c_custkey long, c_nationkey long, c_mktsegment string", [(0, 0, "A"), (1, 1, "B"), (1, 0, "B"), (2, None, "C"), (None, 1, "D")]),
        "orders": (
            "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string",
            [(1, 0, "O", "1"), (2, 1, "F", None), (3, 2, "P", "1"), (4, None, "O", "1"), (5, 9, "O", "1")],
        ),
        "supplier": ("s_suppkey long, s_nationkey long", [(1, 0)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_size int", [(1, "p", "b", 3)]),
        "lineitem": ("l_orderkey long, l_partkey long", [(1, 1)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    lazy, written = table_graph.build(spark, str(tmp_path)), table_graph.stored(spark, str(tmp_path))
    for part in ("nodes", "edges", "references"):
        plan = getattr(lazy, part)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [o_custkey" in plan and "BroadcastHashJoin [o_custkey" not in plan
        same = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
        assert same(getattr(lazy, part)) == same(getattr(written, part))
    functions = written.nodes.filter("type = 'function'").select("id", "file_id").collect()
    assert sorted(r[0] for r in functions) == ["func:1", "func:2", "func:2"]
