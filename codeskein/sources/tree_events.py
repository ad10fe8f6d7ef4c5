"""A source-code tree as a stream of settled changes.

An offset is a moment in time. The files between two offsets are those whose last change lies
between them, and the newest offset trails the clock by the debounce time: a file that keeps
changing keeps moving its own change time out of reach and shows up once, when it has been
quiet for long enough. So the debounce needs no state, and any range can be read again.
"""

from __future__ import annotations

import datetime
import os
import time
from collections.abc import Iterator

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from codeskein.sources.repo_files import Subtree, TreeWalk

TREE_EVENTS = "path string, changed_at timestamp"


class _Range(Subtree):
    def __init__(self, subtree: Subtree, start: int, end: int):
        super().__init__(subtree.folder, subtree.recursive)
        self.start, self.end = start, end


class _Reader(TreeWalk, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.settle_ns = int(float(options.get("settle_seconds", "0.5")) * 1e9)
        self.since_ns = int(options.get("since_ns", time.time_ns()))

    def initialOffset(self) -> dict:
        return {"ns": self.since_ns}

    def latestOffset(self) -> dict:
        return {"ns": max(time.time_ns() - self.settle_ns, self.since_ns)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return [_Range(s, start["ns"], end["ns"]) for s in self.split()]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for entry in self.walk(partition):
            try:
                changed = entry.stat().st_ctime_ns
            except OSError:
                continue
            if partition.start < changed <= partition.end:
                at = datetime.datetime.fromtimestamp(changed / 1e9, tz=datetime.timezone.utc)
                yield os.path.relpath(entry.path, self.root), at

    def commit(self, end: dict) -> None:
        pass


class TreeEvents(DataSource):
    """`spark.readStream.format("code_tree_events").load(root)`: files that changed and settled."""

    @classmethod
    def name(cls) -> str:
        return "code_tree_events"

    def schema(self) -> str:
        return TREE_EVENTS

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Reader(dict(self.options))
