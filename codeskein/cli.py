"""Command line: index, query, find, file, stats, watch, graph."""

from __future__ import annotations

import argparse
import time
from pathlib import Path

from pyspark.sql import functions as F

from codeskein.functions import paths
from codeskein.operators import export
from codeskein.plans.engine import QueryEngine
from codeskein.plans.indexer import CodeIndexer
from codeskein.search import VectorStore
from codeskein.session import local_session
from codeskein.store import GraphStore

# What `query --type` takes.
TYPE_CHOICES = ("function", "class", "file", "any")


def data_dir(root: Path) -> Path:
    return root / ".codeskein"


def _show(rows, columns: tuple[str, ...]) -> None:
    """A plain table of a bounded result."""
    cells = [columns, *[tuple("" if row[c] is None else str(row[c]) for c in columns) for row in rows]]
    widths = [max(len(line[i]) for line in cells) for i in range(len(columns))]
    for line in cells:
        print("  ".join(text.ljust(width) for text, width in zip(line, widths)).rstrip())


def index(args, store, engine, root) -> None:
    indexer = CodeIndexer(str(root), store)
    if args.full or store.nodes.isEmpty():
        counts = indexer.index_full()
    else:
        counts = indexer.index_incremental()
    full = ("files_processed", "functions", "classes", "imports")
    for label in (*full, "files_added", "files_modified", "files_deleted"):  # an incremental run may turn into a full one
        if label in counts:
            print(f"{label.replace('_', ' ').capitalize()}: {counts[label]}")
    if args.resolve:
        print(f"Resolved references: {indexer.resolve_references()}")
    if args.vectors:
        print(f"Indexed embeddings: {engine.index_vectors()}")


def query(args, store, engine, root) -> None:
    types = () if args.type == "any" else (args.type,)
    result = engine.query(args.text, types, args.limit, not args.no_expand)
    rows = result.nodes.orderBy("rank").select(
        "type",
        "name",
        F.format_string("%.2f", "score").alias("score"),
        paths.location(F.col("file_id"), F.col("start_line")).alias("location"),
    ).collect()
    _show(rows, ("type", "name", "score", "location")) if rows else print("No results found")


def find(args, store, engine, root) -> None:
    where = paths.location(F.col("file_id"), F.col("start_line"), F.col("end_line")).alias("location")
    found = engine.find_definition(args.symbol).nodes.orderBy("id")
    rows = found.select("type", "name", "signature", where, "docstring").toLocalIterator()
    seen = False
    for row in rows:
        seen = True
        print(f"\n{row['type'].upper()}: {row['name']}")
        for label in ("signature", "location", "docstring"):
            if row[label]:
                print(f"  {label.capitalize()}: {row[label]}")
    if not seen:
        print(f"No definition found for '{args.symbol}'")


def file(args, store, engine, root) -> None:
    result = engine.get_file_summary(args.path)
    rows = result.nodes.orderBy(*result.order).select("type", "name", F.coalesce("start_line", "line").alias("line"))
    rows = rows.collect()
    if not rows:
        print(f"No symbols found in '{args.path}'")
        return
    for label in ("functions", "classes", "imports"):
        print(f"{label.capitalize()}: {result.metadata[label]}")
    _show(rows, ("type", "name", "line"))


def stats(args, store, engine, root) -> None:
    print(export.stats_text(store.nodes, store.edges).first()["text"])


def graph(args, store, engine, root) -> None:
    lines = export.dot_lines(store.nodes, store.edges)
    if args.output:
        export.write_dot(store.nodes, store.edges, args.output)
        return
    for row in lines.orderBy("part", "id").toLocalIterator():
        print(row["line"])


def watch(args, store, engine, root) -> None:
    from codeskein.streaming.watcher import FileWatcher

    def tell(path: str, event_type: str) -> None:
        if args.verbose:
            print(f"{event_type}: {path}", flush=True)

    print(f"Watching {root} for changes; Ctrl+C stops")
    try:
        with FileWatcher(CodeIndexer(str(root), store), on_change=tell):
            while True:
                time.sleep(1)
    except KeyboardInterrupt:
        print("Stopped watching")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="codeskein", description="Knowledge graph of a source tree")
    top.add_argument("--repo", "-r", type=Path, default=Path("."))
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("index", help="index the tree")
    one.add_argument("--full", action="store_true")
    one.add_argument("--resolve", action=argparse.BooleanOptionalAction, default=True)
    one.add_argument("--vectors", action=argparse.BooleanOptionalAction, default=True)
    one = commands.add_parser("query", help="search by text")
    one.add_argument("text")
    one.add_argument("--type", "-t", choices=TYPE_CHOICES, default="any")
    one.add_argument("--limit", "-n", type=int, default=10)
    one.add_argument("--no-expand", action="store_true")
    commands.add_parser("find", help="find a definition").add_argument("symbol")
    commands.add_parser("file", help="symbols of a file").add_argument("path")
    commands.add_parser("stats", help="counts per type")
    commands.add_parser("graph", help="DOT text").add_argument("--output", "-o")
    commands.add_parser("watch", help="follow changes").add_argument("--verbose", "-v", action="store_true")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    root = args.repo.resolve()
    spark = local_session()
    folder = data_dir(root)
    store = GraphStore(spark, str(folder / "graph"))
    engine = QueryEngine(store, VectorStore(spark, str(folder / "vectors")))
    globals()[args.command](args, store, engine, root)
    store.close()


if __name__ == "__main__":
    main()
