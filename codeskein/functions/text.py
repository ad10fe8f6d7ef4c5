"""How a node is worded: the searchable document and the block shown in a context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _filled(name: str) -> Column:
    value = F.col(name)
    return F.when(value != "", value)


def document() -> Column:
    """Searchable text of a node row; parts that are missing or empty leave no blank."""
    kind = F.col("type")
    return (
        F.when(kind == "function", F.concat_ws(" ", "name", _filled("signature"), _filled("docstring")))
        .when(kind == "class", F.concat_ws(" ", "name", _filled("docstring")))
        .when(kind == "file", F.concat_ws(" ", "name", "path"))
        .otherwise(F.col("name"))
    )


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def context_block() -> Column:
    """The lines that describe a node row in a context string."""
    kind = F.col("type")
    head = F.concat(F.lit("# "), F.upper(kind), F.lit(": "), F.col("name"))
    doc = _labelled("Docstring", _filled("docstring"))
    file_line = _labelled("File", F.col("file_id"))
    lines = F.concat(
        F.lit("Lines: "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")
    )
    # A function always shows its signature line, even an empty one.
    signature = _labelled("Signature", F.coalesce(F.col("signature"), F.lit("")))
    bases = F.when(F.size("bases") > 0, _labelled("Bases", F.array_join("bases", ", ")))
    return (
        F.when(kind == "function", F.concat_ws("\n", head, signature, file_line, lines, doc))
        .when(kind == "class", F.concat_ws("\n", head, file_line, bases, doc))
        .when(
            kind == "file",
            F.concat_ws(
                "\n", head, _labelled("Path", F.col("path")), _labelled("Language", F.col("language"))
            ),
        )
        .otherwise(head)
    )
