"""Fixed schemas of the property graph: nodes, edges, open references, changes, file events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The node and edge vocabularies.
NODE_TYPES = ("file", "function", "class", "import", "variable")
EDGE_TYPES = ("defines", "contains", "imports", "calls", "inherits", "uses")

_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
_STRINGS = T.ArrayType(T.StringType())
_METADATA = T.MapType(T.StringType(), T.StringType())


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


NODES = _schema(
    ("id", _S),
    ("type", _S),
    ("name", _S),
    ("metadata", _METADATA),
    ("file_id", _S),
    ("class_id", _S),
    ("path", _S),
    ("language", _S),
    ("last_modified", T.TimestampType()),
    ("size_bytes", _L),
    ("line_count", _I),
    ("signature", _S),
    ("docstring", _S),
    ("start_line", _I),
    ("end_line", _I),
    ("is_async", _B),
    ("is_method", _B),
    ("parameters", _STRINGS),
    ("return_type", _S),
    ("bases", _STRINGS),
    ("decorators", _STRINGS),
    ("module", _S),
    ("alias", _S),
    ("items", _STRINGS),
    ("line", _I),
    ("type_hint", _S),
    ("scope", _S),
    ("ord", _L),
)

# `ord` is the position in which an edge was found in its file; `owner` is the file that produced it.
EDGES = _schema(
    ("source_id", _S),
    ("target_id", _S),
    ("type", _S),
    ("metadata", _METADATA),
    ("ord", _L),
    ("owner", _S),
)

CHANGES = _schema(("path", _S), ("status", _S), ("old_path", _S))

FILE_EVENTS = _schema(
    ("path", _S),
    ("dest_path", _S),
    ("event_type", _S),
    ("is_directory", _B),
    ("ts", T.TimestampType()),
    ("seq", _L),
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project `df` onto `schema`: missing columns become NULL, surplus ones are dropped."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def owner_of_node() -> F.Column:
    """The file a node belongs to; a file owns itself, a free-standing node too."""
    return F.coalesce(F.col("file_id"), F.col("id"))
