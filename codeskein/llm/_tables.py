"""Intermediate tables in the shared folder, ranges of documents in order, and prefix sums over ranges."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeskein.session import work_folder


class Scratch:
    """Written tables of one call, below the folder that `spark.checkpoint.dir` names.

    Writing cuts the lineage: a lost executor repeats one step, and later plans know real sizes.
    Tables that only steps inside the call read go with `drop`; those that the returned rows
    still come from stay.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**options).parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_of(column: Column, bounds: list) -> Column:
    """Which of the ranges cut at the ascending `bounds` a value lies in; null counts as the smallest.

    Two searches over about sqrt(n) values each, so thousands of ranges cost a row little.
    """
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    heads = F.array(*[F.lit(b[0]) for b in blocks])
    tails = F.array(*[F.array(*[F.lit(x) for x in b[1:]]).cast("array<bigint>") for b in blocks])
    at = F.size(F.filter(heads, lambda x: x <= column))
    inner = F.size(F.filter(F.element_at(tails, F.greatest(at, F.lit(1))), lambda x: x <= column))
    return F.when(at == 0, 0).otherwise((at - 1) * width + 1 + inner).cast("int")


def id_bounds(df: DataFrame, column: str, n: int) -> list[int]:
    """At most n - 1 ascending values that cut `column` into ranges of about equal numbers of rows."""
    if n < 2:
        return []
    shares = [i / n for i in range(1, n)]
    got = df.agg(F.percentile_approx(column, shares, F.lit(max(10000, 50 * n)))).first()[0]
    return sorted(set(got or []))


def in_ranges(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows dealt by ranges of a bigint column, with the range's number in `range_no`; one shuffle.

    Range k is partition k. Only the numbers are looked at to find the ranges.
    """
    return df.withColumn("range_no", range_of(F.col(column), id_bounds(df, column, n)))
