"""Session set-up and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", name: str = "codeskein", **conf: str) -> SparkSession:
    """A session for tests, the CLI and benchmarks; a cluster job brings its own."""
    n = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local master may fall back to a folder of its own: on a cluster the executors would
    not see it, so a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="codeskein-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Even out rows whose work lies in Python or in what they point to, not in their own size.

    A few megabytes of paths may stand for terabytes of text, which adaptive execution cannot see;
    a given number of partitions is left alone by it.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 4, *columns)


@contextmanager
def writers_by_value(spark: SparkSession, most: int = 16) -> Iterator[None]:
    """Tasks that write a folder a value keep a file open for each of `most` values instead of sorting their rows by it."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, label: str = "cut", partition_by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back, if asked in one folder per column value.

    The plan behind it is forgotten, lost executors cost no recomputation, and the planner
    learns the real size, which is what decides whether a later join may broadcast it.
    """
    spark = df.sparkSession
    folder = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if partition_by:
        with writers_by_value(spark):
            df.write.partitionBy(partition_by).parquet(folder)
    else:
        df.write.parquet(folder)
    written = spark.read.schema(df.schema).parquet(folder)
    written._cut_folder = folder
    return written


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any store that Spark reaches; none if there is no such folder."""
    files, path = _hadoop(spark, folder)
    return [entry.getPath().getName() for entry in files.listStatus(path)] if files.exists(path) else []


def remove(spark: SparkSession, folder: str) -> None:
    files, path = _hadoop(spark, folder)
    files.delete(path, True)


def release(*frames: DataFrame | None) -> None:
    """Delete what `cut` wrote for these frames. Nothing that still reads them may follow."""
    for frame in frames:
        folder = getattr(frame, "_cut_folder", None)
        if folder:
            remove(frame.sparkSession, folder)
