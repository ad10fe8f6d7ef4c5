"""Operators over file events, for batches and for the micro-batches of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeskein.functions import paths
from codeskein.session import cut, release
from codeskein.versions import Layout, VersionedTables

DEBOUNCE_SECONDS = 0.5
_HELD = "path string, event_type string, ts timestamp, seq long, arrived double"


def split_moves(events: DataFrame) -> DataFrame:
    """A move becomes the deletion of its source and the creation of its destination."""
    kept = [c for c in events.columns if c not in ("path", "dest_path", "event_type")]
    moved = F.array(
        F.struct(F.col("path"), F.lit("deleted").alias("event_type")),
        F.struct(F.col("dest_path").alias("path"), F.lit("created").alias("event_type")),
    )
    single = F.array(F.struct(F.col("path"), F.col("event_type")))
    parts = F.when(F.col("event_type") == "moved", moved).otherwise(single)
    return events.select(*kept, F.explode(parts).alias("part")).select("part.*", *kept)


def code_events(events: DataFrame, suffixes: list[str]) -> DataFrame:
    """Events of source files: no directories, moves split, each side judged by its own suffix."""
    files = events.filter(~F.coalesce(F.col("is_directory"), F.lit(False)))
    return split_moves(files).filter(paths.has_suffix(F.col("path"), suffixes))


def debounce(events: DataFrame, seconds: float = DEBOUNCE_SECONDS, slice_seconds: float | None = None) -> DataFrame:
    """The last event of every burst: (path, event_type, ts).

    An event is kept if nothing else happens to its path in less than `seconds` after it.

    Time is cut into slices no shorter than the gap. Within a slice the next event is the next
    row; for the last row of a slice it can only lie in the following slice, whose first event is
    joined in. Sorting is thus per (path, slice), so one path that holds a third of all events
    is still worked on by many tasks.
    """
    return _bursts(events, seconds, slice_seconds).select("path", "event_type", "ts")


def _bursts(events: DataFrame, seconds: float, slice_seconds: float | None = None) -> DataFrame:
    width = max(slice_seconds or 0.0, seconds * 64)
    instants = events.groupBy("path", "ts").agg(F.max(F.struct("seq", "event_type")).alias("top")).select("path", "ts", "top.*")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    sliced = instants.withColumns({"at": micros, "slice": F.floor(micros / F.lit(width * 1e6))})
    firsts = sliced.groupBy("path", "slice").agg(F.min("at").alias("opens"))
    upcoming = firsts.select("path", (F.col("slice") - 1).alias("slice"), "opens")
    in_slice = Window.partitionBy("path", "slice").orderBy("at")
    lined = sliced.withColumn("following", F.lead("at").over(in_slice)).join(upcoming, ["path", "slice"], "left")
    quiet = F.coalesce(F.coalesce("following", "opens") - F.col("at") >= F.lit(seconds * 1e6), F.lit(True))
    return lined.filter(quiet).select("path", "event_type", "ts", "seq")


class BurstSettler:
    """`debounce` over the micro-batches of a stream, with a table of what is not settled yet between them.

    Of each path only its latest event is open; it settles when a later event lies at least the gap after it, or
    when no event of the path has arrived for as long. No event is dropped for being late: one that arrives after its
    burst was told begins a burst of its own. Each batch is debounced as a whole, so a hot path is many tasks' work.

    With a `folder` that table is kept there, in one commit with the number of the batch and the bursts that are due, so
    a process that ends at any place goes on from its last commit: a batch that comes again is known by its number, and
    what was due and not reported as `done` is due again.
    """

    def __init__(self, spark: SparkSession, seconds: float = DEBOUNCE_SECONDS, folder: str | None = None):
        self.spark, self.seconds = spark, seconds
        held = Layout(T.StructType.fromDDL(_HELD), ("path",), ("path",))
        self.tables = VersionedTables(spark, folder, {"open": held, "due": held}) if folder else None
        self._open: DataFrame | None = None
        self._written: tuple = ()

    @property
    def open(self) -> DataFrame | None:
        """Events that still wait: (path, event_type, ts, seq, arrived)."""
        return self.tables.rows("open").all() if self.tables else self._open

    def idle(self) -> bool:
        """Whether nothing waits and nothing is due."""
        if self.tables:
            return not any(e["kind"] == "rows" for e in self.tables.entries())
        return self._open is None or self._open.isEmpty()

    def settle(self, batch: DataFrame | None, now: float | None, number: int | None = None) -> DataFrame:
        """Bursts (path, event_type, ts) settled by a batch (path, event_type, ts, seq) and the clock; `now=None` settles all.

        The result is there until the next call, or with a folder until `done`. `number` is the batch's own number.
        """
        if self.tables and number is not None and number <= int(self.tables.facts().get("batch", -1)):
            batch = None
        held = self.open
        if batch is not None:
            fresh = batch.select("path", "event_type", "ts", "seq", F.lit(now or 0.0).alias("arrived"))
            held = fresh if held is None else held.unionByName(fresh)
        if held is None:
            return self.spark.createDataFrame([], "path string, event_type string, ts timestamp")
        held = cut(held, "held")
        last = held.groupBy("path").agg(F.max("ts").alias("last_ts"), F.max("arrived").alias("arrived"))
        waits = F.lit(False)
        if now is not None:
            waits = (F.col("ts") == F.col("last_ts")) & (F.col("arrived") + F.lit(self.seconds) > F.lit(now))
        marked = cut(_bursts(held, self.seconds).join(last, "path").withColumn("waits", waits), "bursts")
        parts = {"open": marked.filter("waits"), "due": marked.filter("NOT waits")}
        if self.tables:
            facts = {} if number is None else {"batch": str(number)}
            self.tables.commit(parts, replaced=["open"], facts=facts)
            release(held, marked)
            return self.tables.rows("due").all().select("path", "event_type", "ts")
        release(*self._written)
        self._written = (held, marked)
        self._open = parts["open"].select("path", "event_type", "ts", "seq", "arrived")
        return parts["due"].select("path", "event_type", "ts")

    def done(self) -> None:
        """What was due has been dealt with."""
        if self.tables and any(e["name"] == "due" for e in self.tables.entries()):
            self.tables.commit(replaced=["due"])
