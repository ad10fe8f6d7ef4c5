import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from codeskein import CodeIndexer, GraphStore
from codeskein.schema import FILE_EVENTS
from codeskein.streaming import events as file_events
from codeskein.streaming.watcher import FileWatcher

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def frame(spark, *rows):
    """Events from (path, type, seconds[, destination])."""
    data = [
        (r[0], r[3] if len(r) > 3 else None, r[1], False, START + timedelta(seconds=r[2]), i) for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(data, FILE_EVENTS)


def settled(df):
    return sorted((r["path"], r["event_type"]) for r in df.collect())


def test_debounce(spark):
    once = frame(spark, ("p", "created", 0.0), ("p", "modified", 0.3), ("p", "modified", 0.6))
    assert settled(file_events.debounce(once)) == [("p", "modified")]
    assert settled(file_events.debounce(frame(spark, ("p", "created", 0.0), ("p", "deleted", 0.2)))) == [("p", "deleted")]
    twice = frame(spark, ("p", "modified", 0.0), ("p", "created", 1.0), ("q", "created", 0.4))
    assert settled(file_events.debounce(twice)) == [("p", "created"), ("p", "modified"), ("q", "created")]
    # Quiet for exactly the gap is quiet enough; of two events at one instant the later one counts.
    edge = frame(spark, ("p", "modified", 0.0), ("p", "created", 0.5), ("p", "deleted", 0.5))
    assert settled(file_events.debounce(edge)) == [("p", "deleted"), ("p", "modified")]


def test_debounce_across_slices(spark):
    rows = [("p", f"e{i}", 31.0 + i * 0.3) for i in range(8)] + [("p", "last", 100.0)]
    assert settled(file_events.debounce(frame(spark, *rows))) == [("p", "e7"), ("p", "last")]


def test_moves_and_suffixes(spark):
    moved = frame(spark, ("a.py", "moved", 0.0, "b.txt"), ("c.txt", "moved", 0.0, "d.PY"), ("e.md", "created", 0.0))
    assert settled(file_events.code_events(moved, [".py"])) == [("a.py", "deleted"), ("d.PY", "created")]
    folders = frame(spark, ("x.py", "created", 0.0)).withColumn("is_directory", F.lit(True))
    assert file_events.code_events(folders, [".py"]).count() == 0


def _stream(spark, tmp_path, *batches):
    folder = tmp_path / "events"
    for i, rows in enumerate(batches):
        frame(spark, *rows).coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema(FILE_EVENTS).option("maxFilesPerTrigger", 1).json(str(folder))


def test_stream_equals_batch(spark, tmp_path):
    first = [("p.py", "created", 0.0), ("p.py", "modified", 0.3), ("q.py", "deleted", 2.0), ("p.py", "deleted", 5.0)]
    more = [("z.py", "created", 60.0), ("p.py", "created", 5.2), ("z.py", "modified", 60.5)]
    settler, told = file_events.BurstSettler(spark), []
    query = _stream(spark, tmp_path, first, more).writeStream.option("checkpointLocation", str(tmp_path / "state"))
    query.foreachBatch(lambda batch, _: told.extend(settled(settler.settle(batch, 1e9)))).trigger(availableNow=True).start().awaitTermination(120)
    assert len(told) == 2 and settler.open.count() == 3
    told += settled(settler.settle(None, None))
    assert sorted(told) == settled(file_events.debounce(frame(spark, *first, *more)))


def test_bursts_settle_by_the_clock_and_late_events_are_told(spark):
    settler = file_events.BurstSettler(spark, 0.5)
    assert settled(settler.settle(frame(spark, ("a", "created", 100.0)), 1000.0)) == []
    assert settled(settler.settle(None, 1000.4)) == []
    assert settled(settler.settle(None, 1000.5)) == [("a", "created")]
    assert settled(settler.settle(frame(spark, ("a", "modified", 3.0)), 2000.0)) == []
    assert settled(settler.settle(None, 2001.0)) == [("a", "modified")]
    assert settler.open.isEmpty()


def test_watching_a_stream_of_events(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("class A: pass\n")
    (root / "b.py").write_text("from a import A\nclass B(A): pass\n")
    store = GraphStore(spark)
    indexer = CodeIndexer(str(root), store)
    indexer.index_full()
    (root / "c.py").write_text("class C(A): pass\n")
    (root / "b.py").unlink()
    told = []
    feed = _stream(
        spark, tmp_path,
        [(str(root / "c.py"), "created", 0.0), (str(root / "c.py"), "modified", 0.2), ("b.py", "deleted", 1.0), ("n.txt", "created", 1.0)],
        [("later.py", "created", 100.0)],
    )
    watcher = FileWatcher(indexer, lambda *change: told.append(change), events=feed, checkpoint=str(tmp_path / "state"))
    with watcher:
        assert watcher.is_running()
        watcher.start()  # already started
        watcher.process_available()
    assert not watcher.is_running()
    assert sorted(told) == [("b.py", "deleted"), ("c.py", "modified"), ("later.py", "created")]
    assert {r["path"] for r in store.get_nodes_by_type("file").collect()} == {"a.py", "c.py"}
    assert store.get_edges_to("class:file:a.py:A", "inherits").first()["source_id"] == "class:file:c.py:C"


def test_watching_a_tree(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("x = 1\n")
    (root / "old.py").write_text("x = 1\n")
    indexer = CodeIndexer(str(root), GraphStore(spark))
    indexer.index_full()
    told = []
    with FileWatcher(indexer, lambda *change: told.append(change), poll="500 milliseconds"):
        time.sleep(3)
        (root / "a.py").write_text("def f(): pass\n")
        (root / "new.ts").write_text("class N {}\n")
        (root / "no.txt").write_text("no\n")
        (root / "old.py").unlink()
        deadline = time.time() + 90
        while len(set(told)) < 3 and time.time() < deadline:
            time.sleep(0.5)
    assert set(told) == {("a.py", "modified"), ("new.ts", "created"), ("old.py", "deleted")}
    assert indexer.store.get_nodes_by_name("f").count() == 1


def test_bursts_survive_a_restart_at_any_place(spark, tmp_path):
    def begun():
        return file_events.BurstSettler(spark, 0.5, str(tmp_path / "bursts"))

    first = frame(spark, ("a", "created", 100.0), ("b", "created", 100.0), ("b", "modified", 200.0))
    settler = begun()
    assert settled(settler.settle(first, 1000.0, 0)) == [("b", "created")]
    settler.done()
    again = begun()  # the batch comes a second time: it was committed, the stream's own mark was not
    assert settled(again.settle(first, 1000.1, 0)) == [] and again.open.count() == 2
    assert settled(begun().settle(None, 1001.0)) == [("a", "created"), ("b", "modified")]
    late = begun()  # ended before these were dealt with: still due, with what came meanwhile
    assert settled(late.settle(frame(spark, ("c", "deleted", 300.0)), 1002.0, 1)) == [("a", "created"), ("b", "modified")]
    assert not late.idle()
    late.done()
    assert settled(begun().settle(None, 1003.0)) == [("c", "deleted")]
    last = begun()
    last.done()
    assert last.idle() and settled(last.settle(None, 1004.0)) == []


def test_a_failing_change_is_told_later_and_once(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("x = 1\n")
    indexer = CodeIndexer(str(root), GraphStore(spark))
    told, calls = [], []
    really = indexer.apply_events

    def sometimes(events):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("not now")
        really(events)

    monkeypatch.setattr(indexer, "apply_events", sometimes)
    feed = _stream(spark, tmp_path, [(str(root / "a.py"), "created", 0.0)])
    with FileWatcher(indexer, lambda *change: told.append(change), events=feed, checkpoint=str(tmp_path / "state")):
        deadline = time.time() + 90
        while not told and time.time() < deadline:
            time.sleep(0.5)
    assert told == [("a.py", "created")] and len(calls) == 2
    assert indexer.store.get_nodes_by_type("file").count() == 1
