"""Parsing as a dataframe pipeline: files in, nodes, edges and references out.

Files are independent, so parsing is one map over a repartitioned table of texts; nothing is
shuffled afterwards, since ids contain their file and repeats can only be in the same file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeskein.functions import paths
from codeskein.parsing import python_reader
from codeskein.parsing.apart import in_children
from codeskein.parsing.registry import ParserRegistry, Reader
from codeskein.parsing.shapes import Shapes
from codeskein.schema import EDGES, NODES, conform

_STRINGS = T.ArrayType(T.StringType())
DECLARATIONS = T.StructType(
    [
        T.StructField(name, kind, True)
        for name, kind in [
            ("file_id", T.StringType()),
            ("language", T.StringType()),
            ("path", T.StringType()),
            ("size_bytes", T.LongType()),
            ("last_modified", T.TimestampType()),
            ("line_count", T.IntegerType()),
            ("ord", T.IntegerType()),
            ("is_last", T.BooleanType()),
            ("kind", T.StringType()),
            ("name", T.StringType()),
            ("scope", T.StringType()),
            ("is_method", T.BooleanType()),
            ("start_line", T.IntegerType()),
            ("end_line", T.IntegerType()),
            ("params_text", T.StringType()),
            ("parameters", _STRINGS),
            ("return_type", T.StringType()),
            ("is_async", T.BooleanType()),
            ("docstring", T.StringType()),
            ("bases", _STRINGS),
            ("decorators", _STRINGS),
            ("module", T.StringType()),
            ("alias", T.StringType()),
            ("items", _STRINGS),
            ("type_hint", T.StringType()),
            ("calls", _STRINGS),
        ]
    ]
)
_IDENTITY = ("kind", "scope", "name", "module", "items")
_ROWS_PER_BATCH = 2000


def _identity(language: str, row: dict) -> tuple:
    """What tells ids of one file apart; only Python import ids list their items."""
    items = ",".join(row.get("items") or []) if language == "python" else ""
    return (row["kind"], row.get("scope"), row.get("name"), row.get("module"), items)


def _declarations(registry: ParserRegistry, file: dict, content, readers: dict[str, Reader], ranked: bool, only: frozenset[str]) -> list[dict]:
    """A `file` row, then one row per declaration, or one `error` row if the text cannot be read.

    A file without a reader keeps a NULL language and has no further rows. Readers of `readers` stand in for the registry's.
    Places, and which of equal ids is last, are told if `ranked`. If kinds are given, rows of `only` these are kept.
    """
    path, language = file["path"], registry.language_of(file["path"])
    rows = [{"kind": "file", "line_count": 0, **file}]
    found = []
    try:
        text = content if isinstance(content, str) else bytes(content).decode("utf-8")
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        rows[0]["line_count"] = text.count("\n") + (text[-1:] not in ("", "\n"))
        if language is not None:
            found = (readers.get(language) or registry.get_parser(language))(text, path)
    except Exception as error:
        if language is not None:
            found = [{"kind": "error", "docstring": f"Failed to parse {path}: {error}"}]
    placed = [(i, row) for i, row in enumerate(found) if not only or row["kind"] in only]
    if ranked:  # rows of equal ids are of one kind
        keys = [_identity(language, row) for _, row in placed]
        last = {key: i for key, (i, _) in zip(keys, placed)}
        placed = [(i, {**row, "ord": i, "is_last": last[key] == i}) for key, (i, row) in zip(keys, placed)]
    rows = [row for row in rows if not only or "file" in only] + [row for _, row in placed]
    return [{**row, "file_id": file["file_id"], "language": language} for row in rows]


def parse_files(
    files: DataFrame, registry: ParserRegistry | None = None, columns: Sequence[str] = (), only: Sequence[str] = ()
) -> DataFrame:
    """Declarations of `files` (file_id, path, content[, size_bytes, last_modified]).

    `content` is text or raw bytes. Whole texts are parsed, each content is read once, and rows
    stream through in small batches, so that memory holds a few files at a time. Of declarations of which only
    some `columns`, or `only` rows of some kinds, are asked for, no others leave Python.

    Python texts that differ in names and literals only are parsed once a child (`parsing/shapes.py`).

    CPython never frees the names that its parser has seen. So some thousand files at a time are read in a child of the
    worker, whose end gives the memory back.
    """
    registry = registry or ParserRegistry()
    kinds = T.StructType([f for f in DECLARATIONS if not columns or f.name in columns])
    schema = to_arrow_schema(kinds)
    ranked = "ord" in kinds.names or "is_last" in kinds.names
    fields = frozenset([*columns, *(_IDENTITY if ranked else ("kind",))]) if columns else frozenset()
    only = frozenset(only)
    described = [c for c in ("file_id", "path", "size_bytes", "last_modified") if c in files.columns]

    def read(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = registry.get_parser("python") is python_reader.read
        readers = {"python": Shapes(python_reader.read, fields, only)} if plain else {}
        for batch in batches:
            names = batch.schema.names
            rows: list[dict] = []
            for i in range(batch.num_rows):
                file = {n: c[i].as_py() for n, c in zip(names, batch.columns)}
                content = file.pop("content")
                file.setdefault("size_bytes", len(content.encode() if isinstance(content, str) else content))
                rows += _declarations(registry, file, content, readers, ranked, only)
                if len(rows) >= _ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select(*described, "content").mapInArrow(lambda batches: in_children(read, batches, schema), kinds)


# --- declarations to ids, nodes, edges, references -------------------------------------------


def _class_id() -> F.Column:
    return F.when(F.col("scope").isNotNull(), F.concat(F.lit("class:"), F.col("file_id"), F.lit(":"), F.col("scope")))


def _id() -> F.Column:
    """The id grammar. A Go function names its receiver where the others name the class id."""
    owner = F.coalesce(F.when(F.col("language") == "go", F.col("scope")).otherwise(_class_id()), F.lit("module"))
    listed = (F.col("language") == "python") & (F.size("items") > 0)

    def joined(prefix: str, *parts) -> F.Column:
        return F.concat_ws(":", F.lit(prefix), F.col("file_id"), *parts)

    return (
        F.when(F.col("kind") == "function", joined("func", owner, F.col("name")))
        .when(F.col("kind") == "class", joined("class", F.col("name")))
        .when(F.col("kind") == "variable", joined("var", F.coalesce(_class_id(), F.lit("module")), F.col("name")))
        .when(F.col("kind") == "import", joined("import", F.col("module"), F.when(listed, F.array_join("items", ","))))
    )


def _name() -> F.Column:
    listed = (F.col("language") == "python") & (F.size("items") > 0)
    plain = F.when(F.col("language") == "go", paths.last_part(F.col("module"), "/")).otherwise(F.col("module"))
    return F.when(
        F.col("kind") == "import",
        F.when(listed, F.concat(F.lit("from "), F.col("module"))).otherwise(F.coalesce("alias", plain)),
    ).otherwise(F.col("name"))


def _signature() -> F.Column:
    """Header text in the manner of each language."""
    word = (
        F.when(F.col("language") == "python", "def ")
        .when(F.col("language") == "rust", "fn ")
        .when(F.col("language") == "go", "func ")
        .otherwise(F.when(F.col("scope").isNull(), F.lit("function ")).otherwise(F.lit("")))
    )
    arrow = (
        F.when(F.col("language").isin("python", "rust"), " -> ")
        .when(F.col("language") == "go", " ")
        .otherwise(": ")
    )
    returned = F.coalesce(F.concat(arrow, F.col("return_type")), F.lit(""))
    mark = F.when(F.col("is_async"), F.lit("async ")).otherwise(F.lit(""))
    return F.concat(mark, word, F.col("name"), F.coalesce("params_text", F.lit("()")), returned)


def _identified(declarations: DataFrame) -> DataFrame:
    known = declarations.filter(F.col("kind").isin("function", "class", "import", "variable"))
    return known.select("*", _id().alias("id"), _class_id().alias("class_id"))


def symbol_nodes(declarations: DataFrame) -> DataFrame:
    """Nodes of declarations; of those that share an id the last one in its file. Columns that were not asked for are NULL."""
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in DECLARATIONS if f.name not in declarations.columns]
    declarations = declarations.select("*", *missing)
    kind = F.col("kind")
    is_function, is_class, is_variable = kind == "function", kind == "class", kind == "variable"
    has_line = kind.isin("import", "variable")
    nothing = F.array().cast("array<string>")
    rows = _identified(declarations).filter("is_last").select(
        "id",
        kind.alias("type"),
        _name().alias("name"),
        "file_id",
        F.when(is_function | is_variable, F.col("class_id")).alias("class_id"),
        F.when(is_function, _signature()).alias("signature"),
        F.when(is_function | is_class, F.col("docstring")).alias("docstring"),
        F.when(~has_line, F.col("start_line")).alias("start_line"),
        F.when(~has_line, F.col("end_line")).alias("end_line"),
        F.when(is_function, F.coalesce("is_async", F.lit(False))).alias("is_async"),
        F.when(is_function, F.coalesce(F.col("is_method"), F.col("scope").isNotNull())).alias("is_method"),
        F.when(is_function, F.coalesce("parameters", nothing)).alias("parameters"),
        F.when(is_function, F.col("return_type")).alias("return_type"),
        F.when(is_class, F.coalesce("bases", nothing)).alias("bases"),
        F.when(is_class, F.coalesce("decorators", nothing)).alias("decorators"),
        "module",
        "alias",
        F.when(kind == "import", F.coalesce("items", nothing)).alias("items"),
        F.when(has_line, F.col("start_line")).alias("line"),
        "type_hint",
        F.when(is_variable, F.when(F.col("scope").isNull(), F.lit("module")).otherwise(F.lit("class"))).alias("scope"),
        "ord",
    )
    return conform(rows, NODES)


def symbol_edges(declarations: DataFrame) -> DataFrame:
    """defines, contains and imports edges; both ends lie in the same file."""
    rows = _identified(declarations).filter("is_last AND kind <> 'variable'")
    contained = (F.col("kind") == "function") & F.col("class_id").isNotNull()
    edges = rows.select(
        F.when(contained, F.col("class_id")).otherwise(F.col("file_id")).alias("source_id"),
        F.col("id").alias("target_id"),
        F.when(F.col("kind") == "import", "imports").when(contained, "contains").otherwise("defines").alias("type"),
        "ord",
        F.col("file_id").alias("owner"),
    )
    return conform(edges, EDGES)


def symbol_references(declarations: DataFrame) -> DataFrame:
    """Open references: base classes of a class and callees of a function, each once per source.

    Repeats are removed inside the row; a class or function declared twice may still list one
    twice, which `resolve.resolved_edges` merges.
    """
    rows = _identified(declarations).filter(F.col("kind").isin("function", "class"))
    called = F.transform(F.coalesce("calls", F.array().cast("array<string>")), lambda c: paths.last_part(c, "."))
    kind = F.when(F.col("kind") == "function", F.lit("calls")).otherwise(F.lit("inherits"))
    names = F.when(F.col("kind") == "function", called).otherwise(F.col("bases"))
    wanted = rows.select(
        F.col("id").alias("source_id"),
        kind.alias("type"),
        F.posexplode(F.array_distinct(names)).alias("place", "name"),
        "ord",
        F.col("file_id").alias("owner"),
    )
    return conform(
        wanted.select(
            "source_id",
            paths.placeholder(F.col("type"), F.col("name")).alias("target_id"),
            "type",
            F.create_map(F.lit("unresolved"), F.lit("true")).alias("metadata"),
            F.col("place").alias("ord"),
            "owner",
        ),
        EDGES,
    )


def file_nodes(declarations: DataFrame) -> DataFrame:
    rows = declarations.filter(F.col("kind") == "file").select(
        F.col("file_id").alias("id"),
        F.lit("file").alias("type"),
        paths.base_name(F.col("path")).alias("name"),
        "path",
        paths.language(F.col("path")).alias("language"),
        "last_modified",
        "size_bytes",
        "line_count",
    )
    return conform(rows, NODES)


def indexed_files(declarations: DataFrame) -> DataFrame:
    """(path, errors) of the files that have a reader."""
    read = declarations.filter("language IS NOT NULL AND kind IN ('file', 'error')")
    return read.groupBy("file_id").agg(
        F.max("path").alias("path"), F.count_if(F.col("kind") == "error").alias("errors")
    ).select("path", "errors")


def index_counts(declarations: DataFrame) -> DataFrame:
    """One row of totals of a full run: repeated symbols count each time, a file with an error
    still counts as processed, one without a reader as skipped."""
    kind = F.col("kind")
    is_file = kind == "file"
    return declarations.agg(
        F.count_if(is_file & F.col("language").isNotNull()).alias("files_processed"),
        F.count_if(is_file & F.col("language").isNull()).alias("files_skipped"),
        F.count_if(kind == "error").alias("errors"),
        F.count_if(kind == "function").alias("functions"),
        F.count_if(kind == "class").alias("classes"),
        F.count_if(kind == "import").alias("imports"),
    )
