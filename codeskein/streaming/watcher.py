"""Keeping a stored graph current while files change."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeskein.functions import paths
from codeskein.plans.indexer import CodeIndexer
from codeskein.session import cut, release, work_folder
from codeskein.sources import repo_files
from codeskein.sources.tree_events import TreeEvents
from codeskein.streaming import events as file_events

_LOG = logging.getLogger(__name__)


class FileWatcher:
    """Follows a tree, or a stream of file events, and applies settled changes batch by batch.

    Without `events` the tree itself is polled: changed files come from the `code_tree_events`
    source, deleted ones are those the store knows and the tree lacks. With `events`, a streaming
    DataFrame shaped like `schema.FILE_EVENTS` (a message queue, a folder of logs), bursts are
    settled by `BurstSettler`, by later events or by the clock. `on_change(path, event_type)` runs after a batch was applied.
    With `checkpoint` a watcher that is started anew goes on where the last one ended, whatever ended it: no burst is lost,
    and one is told again only if the process ended between telling it and noting that.
    """

    def __init__(
        self,
        indexer: CodeIndexer,
        on_change: Callable[[str, str], None] | None = None,
        events: DataFrame | None = None,
        seconds: float = file_events.DEBOUNCE_SECONDS,
        poll: str = "1 second",
        checkpoint: str | None = None,
    ):
        self.indexer, self.on_change, self.events = indexer, on_change, events
        self.seconds, self.poll, self.checkpoint = seconds, poll, checkpoint
        self._query: StreamingQuery | None = None
        self._settler: file_events.BurstSettler | None = None
        self._one_at_a_time, self._stopped = threading.Lock(), threading.Event()

    def start(self) -> None:
        """Start following; does nothing if already started."""
        if self.is_running():
            return
        if self.events is not None:
            suffixes = self.indexer.registry.supported_extensions()
            arriving = file_events.code_events(self.events, suffixes)
            spark = self.indexer.store.spark
            # beside the stream's own checkpoint, so that both survive a restart, or for this run only
            folder = f"{self.checkpoint.rstrip('/')}-bursts" if self.checkpoint else f"{work_folder(spark)}/bursts-{uuid.uuid4().hex}"
            self._settler = file_events.BurstSettler(spark, self.seconds, folder)
            self._stopped.clear()
            writer = arriving.writeStream.outputMode("append").foreachBatch(self._settle)
            threading.Thread(target=self._watch_clock, daemon=True).start()
        else:
            writer = self._tree_stream().writeStream.foreachBatch(lambda batch, _: self._apply_tree(batch))
            writer = writer.trigger(processingTime=self.poll)
        if self.checkpoint:
            writer = writer.option("checkpointLocation", self.checkpoint)
        self._query = writer.start()

    def _settle(self, batch: DataFrame | None, number: int | None = None) -> None:
        """Apply the bursts that a batch, or the clock alone, has closed; they stay due until that has succeeded."""
        with self._one_at_a_time:
            if batch is None and self._settler.idle():
                return
            self._apply(self._settler.settle(batch, time.time(), number))
            self._settler.done()

    def _watch_clock(self) -> None:
        """Close bursts that are quiet by the clock while no batch arrives. After an error the next round tries again."""
        while not self._stopped.wait(self.seconds):
            try:
                self._settle(None)
            except Exception:
                _LOG.exception("settling bursts failed, they stay due")

    def _tree_stream(self) -> DataFrame:
        spark = self.indexer.store.spark
        spark.dataSource.register(TreeEvents)
        reader = spark.readStream.format("code_tree_events").option("settle_seconds", str(self.seconds))
        # Changes count from now on, however long the stream takes to get going.
        reader = reader.option("since_ns", str(time.time_ns()))
        return reader.option("ignored", "\n".join(self.indexer.ignored)).load(self.indexer.root)

    def _apply_tree(self, changed: DataFrame) -> None:
        store, indexer = self.indexer.store, self.indexer
        readable = paths.has_suffix(F.col("path"), indexer.registry.supported_extensions())
        known = store.nodes.filter("type = 'file'").select("path").filter(readable)
        present = repo_files.list_files(store.spark, indexer.root, tuple(indexer.ignored))
        gone = known.join(present, "path", "left_anti").select("path", F.lit("deleted").alias("event_type"))
        seen = known.select("path", F.lit("modified").alias("_kind"))
        fresh = changed.filter(readable).select("path").join(seen, "path", "left")
        fresh = fresh.select("path", F.coalesce("_kind", F.lit("created")).alias("event_type"))
        self._apply(gone.unionByName(fresh))

    def _apply(self, settled: DataFrame) -> None:
        """Write the batch aside, apply it, tell the callback."""
        root = self.indexer.root.rstrip("/") + "/"
        path = F.when(F.col("path").startswith(root), F.substr("path", F.lit(len(root) + 1))).otherwise(F.col("path"))
        batch = cut(settled.select(path.alias("path"), "event_type"), "events")
        if not batch.isEmpty():
            self.indexer.apply_events(batch)
            if self.on_change:
                for row in batch.toLocalIterator():
                    self.on_change(row["path"], row["event_type"])
        release(batch)

    def process_available(self) -> None:
        """Wait until everything that has arrived is applied."""
        if self._query:
            self._query.processAllAvailable()
        if self._settler is not None:
            time.sleep(self.seconds)
            self._settle(None)

    def stop(self) -> None:
        if self.is_running():
            self._query.stop()
        self._stopped.set()
        self._query = None

    def is_running(self) -> bool:
        return self._query is not None and self._query.isActive

    def __enter__(self) -> FileWatcher:
        self.start()
        return self

    def __exit__(self, *exc) -> None:
        self.stop()
