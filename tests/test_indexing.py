import shutil
import subprocess

import pytest
from conftest import edge_frame, node_frame
from pyspark.sql import functions as F

from codeskein import CodeIndexer, GraphStore, GraphTraversal, QueryEngine, VectorStore, cli
from codeskein.functions import paths
from codeskein.operators import changes, export
from codeskein.plans.tools import Tools
from codeskein.sources import repo_files

MAIN = '''"""Main module."""

import os
from pathlib import Path


class Config:
    """Configuration class."""

    def __init__(self, path):
        self.path = path

    def load(self) -> dict:
        """Load configuration."""
        return {}


def main():
    """Entry point."""
    config = Config("config.json")
    config.load()
'''
APP = """import { Component } from './component';

interface User { name: string; }

class App {
    private users: User[] = [];
    addUser(user: User): void { this.users.push(user); }
    getUsers(): User[] { return this.users; }
}

export function createApp(): App { return new App(); }
"""


def write(root, path, text):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)


def git(root, *args):
    subprocess.run(["git", "-c", "user.email=a@b.c", "-c", "user.name=n", *args], cwd=root, check=True, capture_output=True)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    write(root, "main.py", MAIN)
    write(root, "app.ts", APP)
    return root


def files_of(store):
    return {r["path"] for r in store.get_nodes_by_type("file").collect()}


def test_scan_sees_hidden_files_and_skips_ignored_ones(spark, tree):
    for path in ("pkg/__init__.py", "pkg/.hidden.py", "node_modules/p.js", "a/build/x.py", "a/builds/y.PY", "b/no.txt"):
        write(tree, path, "x = 1\n")
    found = repo_files.scan(spark, str(tree), [".py", ".ts", ".js"])
    wanted = {"main.py", "app.ts", "pkg/__init__.py", "pkg/.hidden.py", "a/builds/y.PY"}
    assert {r["path"] for r in found.collect()} == wanted
    few = spark.read.format("code_tree").option("subtrees", "1").load(str(tree))
    assert few.filter(~paths.ignored(F.col("path"))).count() == 6


def test_scan_asks_git(spark, tree):
    write(tree, ".gitignore", "out/\n*.gen.py\n")
    write(tree, "out/a.py", "")
    write(tree, "b.gen.py", "")
    git(tree, "init", "-q")
    found = {r["path"] for r in repo_files.scan(spark, str(tree), [".py", ".ts"]).collect()}
    assert found == {"main.py", "app.ts"}
    indexer = CodeIndexer(str(tree), GraphStore(spark))
    assert indexer.should_ignore("out/a.py") and indexer.should_ignore("x/node_modules/y.js")
    assert not indexer.should_ignore("main.py")


def test_full_index_resolve_search_and_summary(spark, tree):
    store = GraphStore(spark)
    indexer = CodeIndexer(str(tree), store)
    stages = []
    counts = indexer.index_full(lambda *stage: stages.append(stage))
    assert counts == {
        "files_processed": 2, "files_skipped": 0, "errors": 0, "functions": 6, "classes": 2, "imports": 3,
    }
    assert stages == [("scan", 1, 3), ("parse", 2, 3), ("store", 3, 3)]
    # `Config(...)` is a class, so only `load` is a known function among the calls of main.
    assert indexer.resolve_references() == 1
    calls = store.edges.filter("type = 'calls'").collect()
    assert [(e["source_id"], e["target_id"]) for e in calls] == [
        ("func:file:main.py:module:main", "func:file:main.py:class:file:main.py:Config:load")
    ]
    engine = QueryEngine(store)
    assert engine.index_vectors() == store.nodes.count()
    result = engine.query("load configuration", max_results=3)
    best = result.nodes.orderBy("rank").first()
    assert best["name"] == "load" and result.metadata["total_results"] == 3
    assert result.context.startswith("# FUNCTION: load\nSignature: def load(self) -> dict\nFile: file:main.py\nLines: 13-15")
    functions = engine.query("load configuration", ["function"], expand_graph=False).nodes
    assert {r["type"] for r in functions.collect()} == {"function"}
    summary = engine.get_file_summary("main.py")
    assert summary.metadata == {"file_path": "main.py", "functions": 1, "classes": 1, "imports": 2}
    assert [r["name"] for r in summary.nodes.orderBy(*summary.order).collect()] == ["main", "Config", "os", "from pathlib"]
    assert engine.find_definition("Config").context == "# CLASS: Config\nFile: file:main.py\nDocstring: Configuration class."
    assert engine.find_symbol("USERS").nodes.count() == 1
    assert engine.find_references("func:file:main.py:class:file:main.py:Config:load").nodes.first()["name"] == "main"
    assert engine.vectors.get(["file:main.py"]).first()["document"] == "main.py main.py"


def test_incremental_without_git_is_full(spark, tree):
    indexer = CodeIndexer(str(tree), GraphStore(spark))
    indexer.index_full()
    write(tree, "main.py", MAIN + "\n\ndef more():\n    pass\n")
    (tree / "app.ts").unlink()
    assert indexer.index_incremental()["functions"] == 4
    assert files_of(indexer.store) == {"main.py"}  # a full run forgets files that are gone


def test_incremental_by_git_on_a_stored_graph(spark, tree):
    folder = str(tree / ".codeskein" / "graph")
    write(tree, "gone.py", "class Base: pass\n")
    write(tree, "user.py", "from gone import Base\nclass Sub(Base): pass\n")
    git(tree, "init", "-q")
    git(tree, "add", ".")
    git(tree, "commit", "-qm", "first")
    indexer = CodeIndexer(str(tree), GraphStore(spark, folder))
    indexer.index_full()
    first = indexer.last_commit()
    assert first and indexer.resolve_references() == 2
    assert indexer.store.get_edges_to("class:file:gone.py:Base", "inherits").count() == 1

    git(tree, "mv", "app.ts", "app2.ts")
    git(tree, "rm", "-q", "gone.py")
    write(tree, "main.py", MAIN + "\n\ndef more():\n    pass\n")
    write(tree, "note.txt", "hello\n")
    store = GraphStore(spark, folder)  # opened anew
    indexer = CodeIndexer(str(tree), store)
    counts = indexer.index_incremental()
    assert counts == {"files_added": 0, "files_modified": 2, "files_deleted": 1, "errors": 0}
    # A file without a reader gets its file node in an incremental run.
    assert files_of(store) == {"main.py", "app2.ts", "user.py", "note.txt"}
    assert store.get_nodes_by_name("more").count() == 1
    assert store.get_edges_from("class:file:user.py:Sub", "inherits").count() == 0
    assert store.edges.filter(F.col("source_id").contains("app.ts")).count() == 0

    # The deleted base comes back: its incoming edge is restored from the kept reference.
    git(tree, "reset", "-q", "--hard")
    indexer.index_full()
    indexer.resolve_references()
    assert store.get_edges_to("class:file:gone.py:Base", "inherits").count() == 1
    git(tree, "rm", "-q", "gone.py")
    git(tree, "commit", "-qam", "second")
    assert indexer.index_incremental(since_commit=first)["files_deleted"] == 1
    assert "gone.py" not in files_of(store) and indexer.last_commit() != first


def test_store_changes(spark, small_graph, tmp_path):
    nodes, edges = small_graph
    for store in (GraphStore(spark), GraphStore(spark, str(tmp_path / "g"))):
        store.add_nodes(nodes)
        store.add_edges(edges)
        assert store.get_stats() == {
            "total_nodes": 4,
            "total_edges": 4,
            "node_types": {"class": 1, "file": 1, "function": 2},
            "edge_types": {"calls": 1, "contains": 1, "defines": 2},
        }
        store.add_nodes(node_frame(spark, [{"id": "file:test.py", "type": "file", "name": "renamed.py"}]))
        assert store.get_node("file:test.py").first()["name"] == "renamed.py" and store.node_count() == 4
        store.remove_node("no such node")
        store.remove_node("func:test.py:module:helper")
        assert (store.node_count(), store.edge_count()) == (3, 2)
        store.add_edges(edge_frame(spark, [("file:test.py", "phantom", "uses")]))
        assert store.get_stats()["node_types"]["unknown"] == 1
        store.remove_file_nodes("test.py")
        assert store.nodes.count() == 0 and store.edge_count() == 0


def test_vector_store(spark, tmp_path):
    rows = [("a", "red green", "function", "a"), ("b", "blue", "class", "b")]
    docs = spark.createDataFrame(rows, "id string, document string, type string, name string")

    def embed(text):  # letter counts: any expression will do
        return F.array(*[F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in "abdeglnru"]).cast(
            "array<double>"
        )

    for store in (VectorStore(spark), VectorStore(spark, str(tmp_path / "v")), VectorStore(spark, embed=embed)):
        store.add(docs)
        store.add(docs.filter("id = 'a'").withColumn("document", F.lit("red rose")))
        assert store.count() == 2
        assert store.get(["a", "zzz"]).first()["document"] == "red rose"
        hits = store.search("red", 5).orderBy("rank").collect()
        assert [h["id"] for h in hits] == ["a", "b"] and hits[0]["distance"] < hits[1]["distance"]
        assert [h["id"] for h in store.search("red", 5, ["class"]).collect()] == ["b"]
        store.delete([])
        store.delete(["a"])
        store.delete_where(F.col("type") == "nothing")
        assert [r["id"] for r in store.documents.collect()] == ["b"]


def _changes(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, status string, old_path string")


def test_change_counts(spark):
    listed = _changes(spark, ("x.py", "A", None), ("y.py", "M", None), ("z.py", "D", None), ("new.py", "R", "old.py"))
    assert {r["path"] for r in changes.removed_paths(listed).collect()} == {"z.py", "old.py"}
    assert {r["path"] for r in changes.paths_to_index(listed).collect()} == {"x.py", "y.py", "new.py"}
    done = spark.createDataFrame([("x.py", 0), ("y.py", 1), ("new.py", 0)], "path string, errors long")
    assert changes.change_counts(listed, done).first().asDict() == {
        "files_added": 1, "files_modified": 2, "files_deleted": 1, "errors": 1,
    }


def test_pending_changes_keep_both_sides(spark):
    staged, unstaged = _changes(spark, ("y.py", "M", None)), _changes(spark, ("y.py", "M", None))
    untracked = spark.createDataFrame([("y.py",), ("n.py",)], "path string")
    found = sorted((r["path"], r["status"]) for r in changes.pending_changes(staged, unstaged, untracked).collect())
    assert found == [("n.py", "A"), ("y.py", "M"), ("y.py", "M")]


def test_status_lines(spark):
    lines = spark.createDataFrame([("M\ta.py",), ("R100\told\tnew",), ("D",), ("T\tt.py",), ("R09\tonly",)], "line string")
    rows = {tuple(r) for r in changes.parse_name_status(lines).select("path", "status", "old_path").collect()}
    assert rows == {("a.py", "M", None), ("new", "R", "old"), ("t.py", "T", None)}


def test_tools_and_dot(spark, tree, small_graph, tmp_path):
    tools = Tools(spark, str(tree))
    assert tools.call("index", {"incremental": False}).startswith("Full index complete:\n- Files processed: 2\n- Functions: 6\n")
    assert "- function: 6\n" in tools.call("graph_stats", {})
    assert tools.call("find_definition", {"symbol": "nope"}) == "No definition found for 'nope'"
    assert tools.call("find_references", {"symbol": "nope"}) == "Symbol 'nope' not found"
    assert tools.call("file_summary", {"file_path": "app.ts"}).startswith("File: app.ts\nFunctions: 1\nClasses: 1\nImports: 1\n\n")
    assert tools.call("query", {"query": "users", "type": "function"}).startswith("# FUNCTION: ")
    assert tools.call("other", {}) == "Unknown tool: other"
    assert tools.call("query", {}).startswith("Error: ")
    export.write_dot(*small_graph, str(tmp_path / "dot"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "dot").glob("part-*")))
    lines = text.splitlines()
    assert lines[0] == "digraph CodeGraph {" and lines[-1] == "}" and len(lines) == 12
    assert '  "file:test.py" [label="file\\ntest.py"];' in lines
    shutil.rmtree(tree)


def test_language_map(spark):
    names = ["test.py", "test.ts", "test.go", "test.rs", "test.unknown", "a.MTS", ".py", "dir.py/x"]
    df = spark.createDataFrame([(n,) for n in names], "path string").select("path", paths.language(F.col("path")).alias("l"))
    wanted = ["python", "typescript", "go", "rust", "unknown", "unknown", "unknown", "unknown"]
    assert [r["l"] for r in df.collect()] == wanted


def test_traversal_of_a_store(spark):
    store = GraphStore(spark)
    for i in "abc":
        store.add_node(id=i, type="class", name=i.upper(), file_id="file:f")
    store.add_node(id="file:f", type="file", name="f", path="f")
    store.add_node(id="import:os", type="import", name="os", module="os", file_id="file:f")
    store.add_edge("b", "a", "inherits")
    store.add_edge("c", "b", "inherits", {"note": "x"})
    store.add_edge("file:f", "import:os", "imports")
    walk = GraphTraversal(store)
    assert [r["id"] for r in walk.find_inheritance_chain("c").orderBy("depth").collect()] == ["b", "a"]
    assert walk.find_subclasses("a").count() == 2
    assert [r["module"] for r in walk.find_dependencies("file:f").collect()] == ["os"]
    assert [r["id"] for r in walk.find_dependents("os").collect()] == ["file:f"]
    assert walk.get_complexity_score("b") == 1.0
    assert walk.find_central_nodes(1).first()["id"] == "a"
    assert [r["id"] for r in walk.search_nodes(lambda n: n["name"] == "C").collect()] == ["c"]
    assert walk.get_related_symbols("a", 1).first()["id"] == "b"
    assert walk.get_file_symbols("file:f").first()["bucket"] == "imports"
    assert store.get_edges_from("c").first()["metadata"] == {"note": "x"}


def test_command_line(spark, tree, capsys):
    def run(*args):
        cli.main(["-r", str(tree), *args])
        return capsys.readouterr().out

    assert "Files processed: 2\nFunctions: 6\n" in run("index", "--no-vectors")
    assert "FUNCTION: load\n  Signature: def load(self) -> dict\n  Location: main.py:13-15" in run("find", "load")
    assert run("find", "nothing") == "No definition found for 'nothing'\n"
    assert "Classes: 1\n" in run("file", "app.ts")
    assert run("graph").startswith("digraph CodeGraph {\n")
    assert run("query", "anything") == "No results found\n"  # no vectors yet
