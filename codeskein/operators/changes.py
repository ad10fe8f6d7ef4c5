"""Change lists of a version-controlled tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.functions import paths


def parse_name_status(lines: DataFrame, column: str = "line") -> DataFrame:
    """Changes from `status<TAB>path[<TAB>new path]` lines; a rename keeps its old path.

    The status is its first letter. Lines without a path are skipped.
    """
    parts = F.split(F.col(column), "\t")
    return from_fields(lines.select(parts[0].alias("status"), F.get(parts, F.lit(1)).alias("first"), F.get(parts, F.lit(2)).alias("second")))


def from_fields(fields: DataFrame) -> DataFrame:
    """Changes from (status, first, second): the path, or the old and the new path of a rename."""
    status = F.substring("status", 1, 1)
    renamed = status == "R"
    return fields.select(
        F.when(renamed, F.col("second")).otherwise(F.col("first")).alias("path"),
        status.alias("status"),
        F.when(renamed, F.col("first")).alias("old_path"),
    ).filter((F.col("path") != "") & (F.col("status") != ""))


def pending_changes(staged: DataFrame, unstaged: DataFrame, untracked: DataFrame) -> DataFrame:
    """Staged and unstaged changes, both kept, plus untracked paths that neither of them names."""
    known = staged.unionByName(unstaged)
    return with_untracked(known, untracked)


def with_untracked(changes: DataFrame, untracked: DataFrame) -> DataFrame:
    added = untracked.select("path").join(changes.select("path"), "path", "left_anti")
    return changes.unionByName(
        added.select("path", F.lit("A").alias("status"), F.lit(None).cast("string").alias("old_path"))
    )


def removed_paths(changes: DataFrame) -> DataFrame:
    """Paths whose symbols must go: deleted ones and the old names of renamed ones."""
    gone = F.when(F.col("status") == "D", F.col("path")).when(F.col("status") == "R", F.col("old_path"))
    return changes.select(gone.alias("path")).filter("path IS NOT NULL").distinct()


def paths_to_index(changes: DataFrame, names: tuple[str, ...] = paths.IGNORED_NAMES) -> DataFrame:
    """Added, modified or renamed paths that are not ignored, each once.

    Files that are gone drop out later, when their content is joined in.
    """
    wanted = changes.filter(F.col("status").isin("A", "M", "R"))
    return wanted.filter(~paths.ignored(F.col("path"), names)).select("path").distinct()


def change_counts(changes: DataFrame, indexed: DataFrame) -> DataFrame:
    """files_added, files_modified, files_deleted, errors of one incremental run, as one row.

    `indexed` (path, errors) lists the files that were read and have a parser. A rename counts as
    modified, a deletion counts even if nothing was there, a path listed twice counts twice.
    """
    done = changes.join(indexed.select("path", "errors"), "path", "left")
    ok = F.col("errors").isNotNull()
    touched = ok & F.col("status").isin("A", "M", "R")
    return done.agg(
        F.count_if(ok & (F.col("status") == "A")).alias("files_added"),
        F.count_if(ok & F.col("status").isin("M", "R")).alias("files_modified"),
        F.count_if(F.col("status") == "D").alias("files_deleted"),
        F.coalesce(F.sum(F.when(touched, F.col("errors"))), F.lit(0)).cast("long").alias("errors"),
    )
