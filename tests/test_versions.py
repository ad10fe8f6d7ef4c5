"""Versioned tables and the stores on them: one commit a change, what failures leave, and which files a lookup opens."""

import os
import random

import pytest
from conftest import edge_frame, node_frame
from pyspark.sql import functions as F

from codeskein import GraphStore, QueryEngine, VectorStore
from codeskein.operators import traversal
from codeskein.versions import KEPT_VERSIONS, LOOKUP_IDS, VersionedTables


def graph(store):
    nodes = sorted((r["id"], r["name"]) for r in store.nodes.select("id", "name").collect())
    edges = sorted(tuple(r) for r in store.edges.select("source_id", "target_id", "type").collect())
    references = sorted(tuple(r) for r in store.references.select("source_id", "target_id", "owner").collect())
    return nodes, edges, references, store.get_state("mark")


def file_rows(spark, name, symbols, calls):
    """A file with functions, and its calls by name."""
    file = f"file:{name}"
    nodes = [{"id": file, "type": "file", "name": name, "path": name}]
    nodes += [{"id": f"func:{file}:module:{s}", "type": "function", "name": s, "file_id": file} for s in symbols]
    edges = edge_frame(spark, [(file, f"func:{file}:module:{s}", "defines") for s in symbols])
    refs = edge_frame(spark, [(f"func:{file}:module:{s}", f"func:?:{c}", "calls") for s, c in calls])
    return {"nodes": node_frame(spark, nodes), "edges": edges.withColumn("owner", F.lit(file)), "references": refs.withColumn("owner", F.lit(file))}


def both(spark, *parts):
    return {k: parts[0][k].unionByName(parts[1][k]) for k in parts[0]}


def files(spark, *names):
    return spark.createDataFrame([(f"file:{n}",) for n in names], "file_id string")


@pytest.fixture
def stored(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    a = file_rows(spark, "a.py", ["one", "two"], [("one", "three")])
    b = file_rows(spark, "b.py", ["three"], [("three", "one")])
    store.replace_all(both(spark, a, b), {"mark": "first"})
    store.resolve()
    return store


class Broken(Exception):
    pass


def test_a_failure_after_any_write_leaves_the_old_version(spark, stored, monkeypatch):
    before = graph(stored)
    new = file_rows(spark, "a.py", ["four"], [("four", "three")])
    really_write, really_list = VersionedTables._write, VersionedTables._list
    for allowed in range(20):
        left = [allowed]

        def counted(really, left=left):
            def write(*args, **options):
                if left[0] == 0:
                    raise Broken
                left[0] -= 1
                really(*args, **options)

            return write

        monkeypatch.setattr(VersionedTables, "_write", counted(really_write))
        monkeypatch.setattr(VersionedTables, "_list", counted(really_list))
        try:
            GraphStore(spark, stored.path).replace_files(files(spark, "a.py"), new, {"mark": "second"})
            break
        except Broken:
            monkeypatch.undo()
            assert graph(stored) == before and graph(GraphStore(spark, stored.path)) == before
    assert allowed > 3
    monkeypatch.undo()
    nodes, edges, references, mark = graph(stored)
    assert [n for n, _ in nodes] == ["file:a.py", "file:b.py", "func:file:a.py:module:four", "func:file:b.py:module:three"]
    assert [r[2] for r in references] == ["file:a.py", "file:b.py"] and mark == "second"
    assert all("one" not in e[0] + e[1] for e in edges)


def test_an_unfinished_list_does_not_count(stored):
    before = graph(stored)
    os.makedirs(f"{stored.path}/versions/{stored.tables.version() + 1:010d}/_temporary")
    assert graph(stored) == before


def test_two_writers_of_one_version_are_an_error(spark, stored):
    other = GraphStore(spark, stored.path)
    number = other.tables.version() + 1
    stored.set_state("mark", "mine")
    with pytest.raises(Exception, match="(?i)exist"):
        other.tables._publish(number, [])
    assert stored.get_state("mark") == "mine"


def written(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{folder}/data") for f in names if f.endswith(".parquet")}


def test_a_changed_file_writes_its_own_rows_only(spark, stored):
    before = written(stored.path)
    stored.replace_files(files(spark, "a.py"), file_rows(spark, "a.py", ["four"], []))
    new = written(stored.path) - before
    assert before <= written(stored.path)
    rows = {kind: sum(spark.read.parquet(f).count() for f in new if f"/data/{kind}/" in f and "/rows/" in f) for kind in ("nodes", "edges", "references")}
    assert rows == {"nodes": 2, "edges": 1, "references": 0}


def test_random_changes_equal_a_plain_model(spark, tmp_path):
    rng = random.Random(7)
    store = GraphStore(spark, str(tmp_path / "g"), merge_after=5, small=rng.choice([0, 10]))
    names, model = [f"{c}.py" for c in "abcd"], {}
    versions = []
    for step in range(9):
        name = rng.choice(names)
        if rng.random() < 0.3 and model:
            store.remove_files(files(spark, name))
            model.pop(name, None)
        else:
            model[name] = [f"f{rng.randrange(9)}_{step}" for _ in range(rng.randrange(4))]
            store.replace_files(files(spark, name), file_rows(spark, name, set(model[name]), []))
        versions.append(store.tables.version())
        expected = sorted([f"file:{n}" for n in model] + [f"func:file:{n}:module:{s}" for n in model for s in set(model[n])])
        assert sorted(r["id"] for r in store.nodes.select("id").collect()) == expected
    assert versions == sorted(set(versions)) and len(store.tables.entries()) < 14
    edges = sorted(tuple(r) for r in store.edges.select("source_id", "target_id").collect())
    assert edges == sorted((f"file:{n}", f"func:file:{n}:module:{s}") for n in model for s in set(model[n]))
    store.tables.compact()
    assert sorted(tuple(r) for r in store.edges.select("source_id", "target_id").collect()) == edges


def test_old_versions_go_with_their_files(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    for k in range(KEPT_VERSIONS + 4):
        store.tables.commit({"nodes": node_frame(spark, [{"id": str(k), "type": "file"}])}, replaced=["nodes"])
    assert len(os.listdir(f"{store.path}/versions")) <= KEPT_VERSIONS + 2
    assert len(os.listdir(f"{store.path}/data/nodes")) <= KEPT_VERSIONS + 1
    assert [r["id"] for r in store.nodes.collect()] == [str(KEPT_VERSIONS + 3)]


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """20,000 functions in a chain and a hub that all call, in files of 500 rows."""
    store = GraphStore(spark, str(tmp_path_factory.mktemp("wide") / "g"), small=100, rows_per_file=500)
    ids = spark.range(20_000).select(F.format_string("func:%05d", "id").alias("id"), F.format_string("func:%05d", F.col("id") + 1).alias("next"))
    nodes = ids.select("id", F.lit("function").alias("type"), F.col("id").alias("name"), F.format_string("file:%s", F.substring("id", 6, 3)).alias("file_id"))
    edges = ids.select(F.col("id").alias("source_id"), F.col("next").alias("target_id")).unionByName(
        ids.select(F.col("id").alias("source_id"), F.lit("func:hub").alias("target_id"))
    )
    edges = edges.withColumns({"type": F.lit("calls"), "owner": F.col("source_id")})
    store.replace_all({"nodes": nodes, "edges": edges, "references": edges.limit(0)})
    return store


def opened(df):
    """Bytes of the files that a plan lists."""
    return sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in df.inputFiles())


def test_lookups_open_few_files(wide):
    everything = opened(wide.nodes), opened(wide.edges)
    assert len(wide.nodes.inputFiles()) >= 40 and len(wide.edges.inputFiles()) >= 80
    for found, n, whole in (
        (wide.get_node("func:12345"), 1, everything[0]),
        (wide.get_edges_from("func:12345"), 2, everything[1]),
        (wide.get_edges_to("func:12345", "calls"), 1, everything[1]),
        (wide.node_rows.near("file_id", "file:123"), 100, everything[0]),
    ):
        assert found.count() == n and 0 < opened(found) <= whole / 20
    assert wide.get_node("func:nowhere").count() == 0 and wide.get_edges_from("a").inputFiles() == []


def test_a_hub_is_spread_over_files(wide):
    assert len(wide.get_edges_to("func:hub").inputFiles()) >= 40
    assert wide.get_edges_to("func:hub").count() == 20_000


def test_walks_open_few_files(wide):
    walk = traversal.neighbours(wide.edge_rows, "func:00500", "out")
    assert opened(walk) <= opened(wide.edges) / 20
    engine = QueryEngine(wide)
    assert sorted(r["id"] for r in engine.traversal.find_callers("func:00500", 2).collect()) == [f"func:{i:05d}" for i in (497, 498, 499)]
    assert engine.traversal.find_callers("func:hub", 0).count() == 20_000  # beyond LOOKUP_IDS: joined with the whole
    assert LOOKUP_IDS < 20_000
    assert engine.traversal.get_related_symbols("func:00000", 1).select("id").collect()[0]["id"] == "func:00001"


def test_types_have_folders(spark, wide):
    wide.add_nodes(node_frame(spark, [{"id": f"class:{i}", "type": "class", "name": "C", "file_id": "file:x"} for i in range(200)]))
    found = wide.get_nodes_by_type("class")
    assert found.count() == 200
    scans = found._jdf.queryExecution().executedPlan().toString()
    assert any("type" in part.split("]")[0] for part in scans.split("PartitionFilters: [")[1:])


def test_collection_versions(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(str(i), f"word{i} common", "function", f"n{i}") for i in range(30)], "id string, document string, type string, name string")
    store = VectorStore(spark, str(tmp_path / "v"), merge_after=8)
    assert store.renew(docs) == 30
    files_before = written(store.path)
    assert store.renew(docs) == 30 and written(store.path) == files_before
    changed = docs.filter("id != '3'").withColumn("document", F.when(F.col("id") == "4", F.lit("fresh")).otherwise(F.col("document")))
    assert store.renew(changed) == 29
    new = [f for f in written(store.path) - files_before if "/rows/" in f]
    assert sum(spark.read.parquet(f).count() for f in new if "/documents/" in f) == 1
    assert store.search("fresh", 1).first()["id"] == "4" and store.search("word3", 1).first()["distance"] == 1.0
    before = sorted(tuple(r) for r in store.documents.select("id", "document").collect())

    def fails(*args, **options):
        raise Broken

    monkeypatch.setattr(VersionedTables, "_list", fails)
    with pytest.raises(Broken):
        store.replace_all(docs.limit(1))
    monkeypatch.undo()
    assert sorted(tuple(r) for r in VectorStore(spark, str(tmp_path / "v")).documents.select("id", "document").collect()) == before
    for i in range(6):
        store.add(docs.filter(F.col("id") == str(i)))
    store.compact()
    assert store.count() == 30 and len([e for e in store.tables.entries() if e["kind"] != "fact"]) == 2
    assert store.search("word3 common", 1).first()["id"] == "3"


def test_ranges_of_files_are_found_without_sorting_the_rows(spark, tmp_path, monkeypatch):
    plans = {}
    write = VersionedTables._write

    def noted(self, rows, folder, by_type=False, **options):
        plans[folder.rsplit("/", 1)[-1], by_type] = rows._jdf.queryExecution().executedPlan().toString()
        write(self, rows, folder, by_type, **options)

    monkeypatch.setattr(VersionedTables, "_write", noted)
    edges = edge_frame(spark, [(f"a{i % 7}", f"b{i}", "calls") for i in range(50)] + [(None, "b3", "uses")])
    store = GraphStore(spark, str(tmp_path / "g"), small=10, rows_per_file=4)
    store.replace_all({"nodes": node_frame(spark, []), "edges": edges, "references": edge_frame(spark, [])})
    assert "SortAggregate" not in plans["files", False]
    # and a long table is cut into more parts than the session's shuffles have
    assert "rangepartitioning" in plans["by_source_id", True] and ", 13)" in plans["by_source_id", True].replace(", REPARTITION_BY_NUM", ")")
    for i in range(7):
        assert sorted(r["target_id"] for r in store.get_edges_from(f"a{i}").collect()) == sorted(f"b{j}" for j in range(50) if j % 7 == i)
    assert store.edges.count() == 51
    store.close()


def test_folders_by_value_are_written_without_a_sort(spark):
    from codeskein.session import cut, release, writers_by_value

    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    with writers_by_value(spark, 9):
        assert spark.conf.get(key) == "9"
    rows = spark.range(1000).selectExpr("id", "concat('t', id % 40) AS type")  # more values than open files
    written = cut(rows, "by_type", "type")
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, rows.collect()))
    assert spark.conf.get(key) == before
    release(written)


def test_references_of_one_owner_fill_several_files(spark, tmp_path):
    rows = edge_frame(spark, [(f"a{i:03}", f"func:?:n{i % 9}", "calls") for i in range(400)])
    for name, refs in (("none", rows.withColumn("owner", F.lit(None).cast("string"))), ("one", rows.withColumn("owner", F.lit("file:x")))):
        store = GraphStore(spark, str(tmp_path / name), small=10, rows_per_file=50)  # eight parts
        store.replace_all({"nodes": node_frame(spark, []), "edges": edge_frame(spark, []), "references": refs})
        [entry] = [e for e in store.tables.entries() if e["name"] == "references"]
        stored = spark.read.parquet(f"{store.tables._folder(entry)}/by_owner")
        tasks = {r["f"].split("part-")[1][:5] for r in stored.select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
        assert len(tasks) > 4 and store.references.count() == 400
