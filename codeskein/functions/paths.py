"""Paths, ids, languages and placeholders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language by lower-case file suffix. `.mts .cts .mjs .cjs` are parsed, yet reported
# as "unknown", as in the behaviour this library reproduces.
LANGUAGE_BY_SUFFIX = {
    ".py": "python",
    ".pyw": "python",
    ".pyi": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".c": "c",
    ".cpp": "cpp",
    ".h": "c",
    ".hpp": "cpp",
    ".rb": "ruby",
    ".php": "php",
}

# Directory and file names that are never scanned, compared whole.
IGNORED_NAMES = (
    ".git",
    ".hg",
    ".svn",
    "__pycache__",
    ".pytest_cache",
    ".mypy_cache",
    ".ruff_cache",
    "node_modules",
    "venv",
    ".venv",
    "env",
    ".env",
    "dist",
    "build",
    ".egg-info",
    ".tox",
    ".nox",
    "target",
    "vendor",
)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot, '' if none. A leading dot alone is no suffix."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    return F.coalesce(_lookup(suffix(path), LANGUAGE_BY_SUFFIX), F.lit("unknown"))


def has_suffix(path: Column, suffixes: list[str]) -> Column:
    return suffix(path).isin(*suffixes)


def ignored(path: Column, names: tuple[str, ...] = IGNORED_NAMES) -> Column:
    """True if any segment of the (relative) path is one of the ignored names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def location(file_id_col: Column, start: Column, end: Column | None = None) -> Column:
    """`path[:start[-end]]`, every `file:` taken out; '' without a file."""
    lines = F.when(start.isNotNull(), F.concat(F.lit(":"), start.cast("string")))
    if end is not None:
        lines = F.concat(lines, F.lit("-"), end.cast("string"))
    return F.coalesce(
        F.concat(F.replace(file_id_col, F.lit("file:"), F.lit("")), F.coalesce(lines, F.lit(""))),
        F.lit(""),
    )


def line_count(content: Column) -> Column:
    """Lines of a text; a trailing newline does not open another one."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    open_line = (F.length(content) > 0) & ~content.endswith("\n")
    return (F.coalesce(breaks, F.lit(0)) + F.coalesce(open_line.cast("int"), F.lit(0))).cast("int")


def last_part(text: Column, separator: str) -> Column:
    return F.substring_index(text, separator, -1)


def placeholder(kind: Column, name: Column) -> Column:
    """The target of a reference whose definition is not known yet."""
    return F.when(kind == "calls", F.concat(F.lit("func:*:*:"), name)).otherwise(
        F.concat(F.lit("class:*:"), name)
    )


def placeholder_type(target: Column) -> Column:
    """The node type a placeholder may resolve to, NULL for anything else."""
    return F.when(target.startswith("func:*:*:"), F.lit("function")).when(
        target.startswith("class:*:"), F.lit("class")
    )


def placeholder_name(target: Column) -> Column:
    return last_part(target, ":")
