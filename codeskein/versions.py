"""Tables in runs that are never changed, and versions that list the runs that count.

A change writes new runs beside the old ones, rows and delete rows, and then one small list; it counts from the moment that list
is complete. Whatever fails before leaves the old version as it was. Readers merge: a row is dead if a delete row of a
later commit has its key. A large run is stored once for each column it is looked up by, sorted by it, and the
lowest and highest value of every file are kept, so that a lookup opens only files that may hold what it asks for.
Small runs are read whole. After some commits the runs are merged into new ones.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeskein.session import listed, remove, writers_by_value

#: More ids than this are joined with the whole table instead of being looked up.
LOOKUP_IDS = 1000
#: The ranges of so many files of a run at most are kept on the driver; those of longer runs are asked for each time.
KNOWN_FILES = 10_000
#: Versions before the latest whose runs are kept for those who still read them.
KEPT_VERSIONS = 16
_ENTRY = "name string, run string, seq long, kind string, value string"


@dataclass(frozen=True)
class Layout:
    """A table's columns; the key by which rows are deleted; the columns it is looked up by; whether it has a folder a type."""

    schema: T.StructType
    key: tuple[str, ...]
    lookups: tuple[str, ...]
    by_type: bool = False
    #: Further columns by which rows of one key are spread over parts, where many rows may share a key (or have none).
    ties: tuple[str, ...] = ()


class StoredRows:
    """One or several tables of the same columns, as one version has them."""

    def __init__(self, tables: VersionedTables, names: Sequence[str], types: Iterable[str] = ()):
        self.tables, self.names, self.types = tables, names, tuple(types)
        self.sparkSession = tables.spark

    def of_types(self, types: Iterable[str]) -> StoredRows:
        return StoredRows(self.tables, self.names, types)

    def all(self) -> DataFrame:
        return self._read(None, None)

    def near(self, column: str, ids: str | Sequence[str] | DataFrame) -> DataFrame:
        """The rows whose `column` is one of the ids; of a long table of ids (column `id`) all rows, which are then to be joined."""
        if isinstance(ids, DataFrame):
            found = ids.select("id").limit(LOOKUP_IDS + 1).collect()
            if len(found) > LOOKUP_IDS:
                return self.all()
            ids = sorted({r["id"] for r in found if r["id"] is not None})
        ids = [ids] if isinstance(ids, str) else list(ids)
        return self._read(column, ids) if len(ids) <= LOOKUP_IDS else self.all().filter(F.col(column).isin(ids))

    def _read(self, column: str | None, ids: list[str] | None) -> DataFrame:
        parts = [self.tables._merged(name, column, ids) for name in self.names]
        rows = reduce(DataFrame.unionByName, parts)
        return rows.filter(F.col("type").isin(*self.types)) if self.types else rows


class VersionedTables:
    def __init__(
        self, spark: SparkSession, path: str, layouts: dict[str, Layout], merge_after: int = 16, small: int = 100_000, rows_per_file: int = 1_000_000
    ):
        self.spark, self.path, self.layouts = spark, path.rstrip("/"), layouts
        self.merge_after, self.small, self.rows_per_file = merge_after, small, rows_per_file
        self._known: tuple[int, list[Row]] = (0, [])
        self._ranges: dict[tuple[str, str], list[Row] | None] = {}

    # --- versions ---

    def version(self) -> int:
        """The latest complete version, 0 before the first."""
        numbers = sorted((int(n) for n in listed(self.spark, f"{self.path}/versions") if n.isdigit()), reverse=True)
        for n in numbers:
            if n == self._known[0] or "_SUCCESS" in listed(self.spark, f"{self.path}/versions/{n:010d}"):
                return n
        return 0

    def _entries_of(self, version: int) -> list[Row]:
        return self.spark.read.schema(_ENTRY).json(f"{self.path}/versions/{version:010d}").collect() if version else []

    def entries(self) -> list[Row]:
        """What the latest version lists; as many entries as runs, which merging bounds."""
        version = self.version()
        if version != self._known[0]:
            self._known = (version, self._entries_of(version))
        return self._known[1]

    def facts(self) -> dict[str, str]:
        return {e["name"]: e["value"] for e in self.entries() if e["kind"] == "fact"}

    def rows(self, *names: str) -> StoredRows:
        return StoredRows(self, names)

    # --- reading ---

    def _folder(self, entry: Row) -> str:
        return f"{self.path}/data/{entry['name']}/{entry['run']}"

    def _part(self, entry: Row, column: str | None, ids: list[str] | None) -> DataFrame | None:
        """The rows of a run, or those that a lookup needs; None if no file can hold any."""
        layout, folder = self.layouts[entry["name"]], self._folder(entry)
        read = self.spark.read.schema(layout.schema)
        if entry["kind"] == "rows":
            part = read.parquet(f"{folder}/rows")
        elif column is None or column not in layout.lookups:
            part = read.parquet(f"{folder}/by_{layout.lookups[0]}")
        else:
            found = self._files(folder, column, ids)
            if not found:
                return None
            part = read.option("basePath", f"{folder}/by_{column}").parquet(*found)
        part = part.select(*layout.schema.names)
        return part if column is None else part.filter(F.col(column).isin(ids))

    def _files(self, folder: str, column: str, ids: list[str]) -> list[str]:
        """The files of a run whose range of `column` holds one of the ids."""
        files = self.spark.read.parquet(f"{folder}/files").filter(F.col("lookup") == column).select("file", "low", "high")
        if (folder, column) not in self._ranges:
            some = files.limit(KNOWN_FILES + 1).collect()
            self._ranges[folder, column] = some if len(some) <= KNOWN_FILES else None
        known = self._ranges[folder, column]
        if known is None:
            inside = F.exists(F.array(*map(F.lit, ids)), lambda v: (F.col("low") <= v) & (v <= F.col("high"))) if ids else F.lit(False)
            known = files.filter(inside).collect()
        ids = sorted(ids)

        def holds(low: str | None, high: str | None) -> bool:
            at = bisect_left(ids, low) if low is not None else len(ids)
            return at < len(ids) and ids[at] <= high

        return [unquote(r["file"]) for r in known if holds(r["low"], r["high"])]

    def _merged(self, name: str, column: str | None, ids: list[str] | None) -> DataFrame:
        layout = self.layouts[name]
        own = [e for e in self.entries() if e["name"] == name]
        dead = [e for e in own if e["kind"] == "dead"]
        last = max((e["seq"] for e in dead), default=-1)
        alive, doubtful = [], []
        for entry in own:
            part = self._part(entry, column, ids) if entry["kind"] in ("rows", "copies") else None
            if part is None:
                continue
            if entry["seq"] < last:
                doubtful.append(part.withColumn("_seq", F.lit(entry["seq"])))
            else:
                alive.append(part)
        if doubtful:
            keys = T.StructType([layout.schema[k] for k in layout.key])
            gone = [self.spark.read.schema(keys).parquet(f"{self._folder(e)}/dead").withColumn("_dead", F.lit(e["seq"])) for e in dead]
            gone = reduce(DataFrame.unionByName, gone)
            if column in layout.key:
                gone = gone.filter(F.col(column).isin(ids))
            gone = gone.groupBy(*layout.key).agg(F.max("_dead").alias("_dead"))
            rows = reduce(DataFrame.unionByName, doubtful)
            same = [rows[k] == gone[k] for k in layout.key]
            alive.append(rows.join(gone, [*same, rows["_seq"] < gone["_dead"]], "left_anti").drop("_seq"))
        return reduce(DataFrame.unionByName, alive) if alive else self.spark.createDataFrame([], layout.schema)

    # --- writing ---

    def _write(self, rows: DataFrame, folder: str, by_type: bool = False, **options: int) -> None:
        """Every write of this class; the one that tests let fail."""
        writer = rows.write.options(**options)
        (writer.partitionBy("type") if by_type else writer).parquet(folder)

    def _stored(self, name: str, rows: DataFrame, seq: int) -> Row | None:
        """Write rows as a run; the entry that lists it, None for no rows."""
        layout = self.layouts[name]
        entry = Row(name=name, run=uuid.uuid4().hex, seq=seq, kind="rows", value=None)
        folder = self._folder(entry)
        # what was cut lies in files already; a long table of that kind is not written once more before it is laid out
        cut = getattr(rows, "_cut_folder", None) is not None and rows.columns == layout.schema.names
        plain, n = rows, rows.count() if cut else 0
        if not cut or n <= self.small:
            self._write(rows.select(*layout.schema.names), f"{folder}/rows")
            plain = self.spark.read.schema(layout.schema).parquet(f"{folder}/rows")
            n = plain.count()
            if n <= self.small:
                return entry if n else None
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for column in layout.lookups:
            # by the rest of the key as well: a node of very many edges is spread over several files
            order = [*(["type"] if layout.by_type else []), column, *[k for k in (*layout.key, *layout.ties) if k not in (column, "type")]]
            # a task sorts `rows_per_file` rows at most on average, however long the table is
            many = -(-n // self.rows_per_file)
            lined = plain.repartitionByRange(*([many] if many > width else []), *order).sortWithinPartitions(*order)
            self._write(lined, f"{folder}/by_{column}", layout.by_type, maxRecordsPerFile=self.rows_per_file)
        # Least and greatest strings alone would be found by sorting all rows of a task by file. Beside a set, that of whether the
        # column has NULLs, Spark keeps them in a hash table of the task's files.
        seen = [
            self.spark.read.schema(layout.schema).parquet(f"{folder}/by_{column}")
            .groupBy(F.col("_metadata.file_path").alias("file"))
            .agg(F.min(column).alias("low"), F.max(column).alias("high"), F.collect_set(F.col(column).isNull()).alias("holes"))
            .withColumn("lookup", F.lit(column))
            for column in layout.lookups
        ]
        self._write(reduce(DataFrame.unionByName, seen), f"{folder}/files")
        remove(self.spark, f"{folder}/rows")
        return Row(**{**entry.asDict(), "kind": "copies"})

    def _deleted(self, name: str, keys: DataFrame, seq: int) -> Row | None:
        entry = Row(name=name, run=uuid.uuid4().hex, seq=seq, kind="dead", value=None)
        self._write(keys.select(*self.layouts[name].key), f"{self._folder(entry)}/dead")
        return None if self.spark.read.parquet(f"{self._folder(entry)}/dead").isEmpty() else entry

    def commit(
        self,
        added: dict[str, DataFrame] | None = None,
        dead: dict[str, DataFrame] | None = None,
        replaced: Iterable[str] = (),
        facts: dict[str, str] | None = None,
    ) -> int:
        """One change: rows that come, keys of rows that go (only older rows), tables that lose all they had, facts.

        Rows and keys may be read from this store; they are written before anything else changes.
        """
        base = self.version()
        seq, replaced, facts = base + 1, set(replaced), facts or {}
        work = [(self._deleted, name, keys, seq) for name, keys in (dead or {}).items() if name not in replaced]
        work += [(self._stored, name, rows, seq) for name, rows in (added or {}).items()]
        new = self._at_once(work)
        kept = [e for e in self.entries() if (e["name"] not in facts if e["kind"] == "fact" else e["name"] not in replaced)]
        kept += [Row(name=k, run=None, seq=seq, kind="fact", value=v) for k, v in facts.items()]
        self._publish(seq, kept + [e for e in new if e is not None])
        if len([e for e in self.entries() if e["kind"] != "fact"]) > self.merge_after + len(self.layouts):
            return self.compact()
        return seq

    def _at_once(self, work: list[tuple]) -> list[Row | None]:
        """The runs of a commit do not depend on each other; their jobs share the cluster."""
        with writers_by_value(self.spark), ThreadPoolExecutor(max(1, len(work))) as pool:
            return [done.result() for done in [pool.submit(*job) for job in work]]

    def _publish(self, seq: int, entries: list[Row]) -> None:
        """List what counts from now on. A version that exists already is an error: someone else was faster."""
        rows = self.spark.createDataFrame([tuple(e) for e in entries], _ENTRY).coalesce(1)
        self._list(rows, f"{self.path}/versions/{seq:010d}")
        self._expire(seq)

    def _list(self, rows: DataFrame, folder: str) -> None:
        rows.write.mode("error").json(folder)

    def compact(self) -> int:
        """Merge the runs of every table that has several into one, as a commit of its own."""
        own = [e["name"] for e in self.entries() if e["kind"] != "fact"]
        several = {name for name in own if own.count(name) > 1}
        if not several:
            return self.version()
        seq = self.version() + 1
        new = self._at_once([(self._stored, name, self._merged(name, None, None), seq) for name in sorted(several)])
        kept = [e for e in self.entries() if e["kind"] == "fact" or e["name"] not in several]
        self._publish(seq, kept + [e for e in new if e is not None])
        return seq

    def _expire(self, latest: int) -> None:
        """Delete old versions, and the runs that no later one lists."""
        old = [int(n) for n in listed(self.spark, f"{self.path}/versions") if n.isdigit() and int(n) < latest - KEPT_VERSIONS]
        if not old:
            return
        numbers = [int(n) for n in listed(self.spark, f"{self.path}/versions") if n.isdigit() and int(n) >= latest - KEPT_VERSIONS]
        used = {(e["name"], e["run"]) for n in numbers for e in self._entries_of(n)}
        for n in old:
            for entry in self._entries_of(n):
                if entry["run"] and (entry["name"], entry["run"]) not in used:
                    remove(self.spark, self._folder(entry))
            remove(self.spark, f"{self.path}/versions/{n:010d}")
