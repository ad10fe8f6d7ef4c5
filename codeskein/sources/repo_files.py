"""A source-code tree as a table.

Spark's file sources pass over names that start with `_` or `.`, which would lose every
`__init__.py`, so listing is a Python data source of its own. It only lists: the driver looks at
the upper directories until there are enough subtrees to hand out, tasks walk those, and reading
happens after the paths have been spread evenly, however lopsided the tree is.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from codeskein.functions import paths
from codeskein.session import spread

CONTENTS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("last_modified", T.TimestampType()),
    ]
)
_BYTES_PER_BATCH = 16 << 20


@dataclass
class Subtree(InputPartition):
    folder: str
    recursive: bool


class TreeWalk:
    """Cuts a tree into subtrees and walks one; ignored names are never entered."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.ignored = frozenset(options.get("ignored", "\n".join(paths.IGNORED_NAMES)).split("\n"))
        self.subtrees = int(options.get("subtrees", "256"))

    def _entries(self, folder: str) -> Iterator[os.DirEntry]:
        """What is in a folder. One that has gone since it was listed is empty; one that cannot be read is an error."""
        try:
            with os.scandir(folder) as entries:
                yield from (e for e in entries if e.name not in self.ignored)
        except FileNotFoundError:
            if folder == self.root:
                raise

    def split(self) -> list[Subtree]:
        level, flat = [self.root], []
        while level and len(level) < self.subtrees:
            below = [e.path for f in level for e in self._entries(f) if e.is_dir(follow_symlinks=False)]
            flat += level
            level = below
            if len(flat) > 16 * self.subtrees:  # deep and thin: leave the rest to the tasks
                break
        return [Subtree(f, False) for f in flat] + [Subtree(f, True) for f in level]

    def walk(self, subtree: Subtree) -> Iterator[os.DirEntry]:
        folders = [subtree.folder]
        while folders:
            for entry in self._entries(folders.pop()):
                if entry.is_dir(follow_symlinks=False):
                    if subtree.recursive:
                        folders.append(entry.path)
                elif not entry.is_dir():
                    yield entry


class _Reader(TreeWalk, DataSourceReader):
    def partitions(self) -> list[Subtree]:
        return self.split()

    def read(self, partition: Subtree) -> Iterator[tuple]:
        for entry in self.walk(partition):
            yield (os.path.relpath(entry.path, self.root),)


class RepoListing(DataSource):
    """`spark.read.format("code_tree").load(root)`: the relative path of every file not ignored."""

    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def schema(self) -> str:
        return "path string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def list_files(spark: SparkSession, root: str, ignored: tuple[str, ...] = paths.IGNORED_NAMES) -> DataFrame:
    spark.dataSource.register(RepoListing)
    return spark.read.format("code_tree").option("ignored", "\n".join(ignored)).load(root)


def scan(
    spark: SparkSession, root: str, suffixes: list[str], ignored: tuple[str, ...] = paths.IGNORED_NAMES
) -> DataFrame:
    """Relative paths to index: right suffix, no ignored segment, not excluded by git."""
    path = F.col("path")
    found = list_files(spark, root, ignored).filter(paths.has_suffix(path, suffixes) & ~paths.ignored(path, ignored))
    return not_git_ignored(spread(found, "path"), root)


def not_git_ignored(files: DataFrame, root: str) -> DataFrame:
    """Drop the paths that the ignore rules of the tree exclude; git is asked once per batch."""
    if not os.path.exists(os.path.join(root, ".git")):
        return files

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            listed = "\0".join(batch["path"])
            asked = subprocess.run(
                ["git", "check-ignore", "-z", "--stdin"], cwd=root, input=listed.encode(), capture_output=True
            )
            if asked.returncode not in (0, 1):  # 1: none of the paths is ignored
                raise RuntimeError(f"git check-ignore failed in {root}: {asked.stderr.decode(errors='replace')}")
            out = set(asked.stdout.decode().split("\0"))
            yield batch[~batch["path"].isin(out)]

    return files.select("path").mapInPandas(run, "path string")


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """Content, size and time of the files that exist (one that exists and cannot be read is an error), see `CONTENTS`, with their `file_id`."""
    schema = to_arrow_schema(CONTENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                full = os.path.join(root, path)
                try:
                    stat = os.stat(full)
                    with open(full, "rb") as handle:
                        content = handle.read()
                except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
                    continue  # no such file any more
                seen = pd.Timestamp(stat.st_mtime_ns // 1000, unit="us", tz="UTC")
                rows.append({"path": path, "content": content, "size_bytes": stat.st_size, "last_modified": seen})
                held += len(content)
                if held >= _BYTES_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    contents = files.select("path").mapInArrow(run, CONTENTS)
    return contents.select("*", paths.file_id(F.col("path")).alias("file_id"))
