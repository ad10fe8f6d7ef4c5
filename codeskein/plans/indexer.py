"""From a source tree to a stored graph, in full or by its changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.functions import paths
from codeskein.operators import changes, symbols
from codeskein.parsing.registry import ParserRegistry
from codeskein.session import cut, spread
from codeskein.sources import repo_files
from codeskein.sources.git import GitTracker
from codeskein.store import GraphStore

# Called with (stage, number of the stage, number of stages): work inside a stage runs on many
# machines at once and has no order to report.
Progress = Callable[[str, int, int], None]


class CodeIndexer:
    def __init__(self, root: str, store: GraphStore, registry: ParserRegistry | None = None):
        self.root, self.store = str(root), store
        self.registry = registry or ParserRegistry()
        self.git = GitTracker(store.spark, self.root)
        self.ignored = [*paths.IGNORED_NAMES, ".codeskein"]

    def add_ignore_pattern(self, name: str) -> None:
        self.ignored.append(name)

    def should_ignore(self, path: str) -> bool:
        """Whether a path relative to the root is passed over."""
        return any(part in self.ignored for part in path.split("/")) or self.git.is_ignored(path)

    def _declarations(self, files: DataFrame) -> DataFrame:
        """Parsed once and written once; nodes, edges and references are read off it."""
        contents = repo_files.read_contents(spread(files, "path"), self.root)
        return cut(symbols.parse_files(contents, self.registry), "declarations")

    @staticmethod
    def _tables(declarations: DataFrame) -> dict[str, DataFrame]:
        return {
            "nodes": symbols.file_nodes(declarations).unionByName(symbols.symbol_nodes(declarations)),
            "edges": symbols.symbol_edges(declarations),
            "references": symbols.symbol_references(declarations),
        }

    def _replace(self, gone: DataFrame, declarations: DataFrame, state: dict[str, str] | None = None) -> None:
        files = gone.unionByName(declarations.filter("kind = 'file'").select("file_id"))
        self.store.replace_files(files, self._tables(declarations), state)

    def index_full(self, progress: Progress | None = None) -> dict[str, int]:
        """Scan, parse and store the whole tree in place of what was stored."""
        report = progress or (lambda *_: None)
        head = self.git.get_current_commit()
        report("scan", 1, 3)
        files = repo_files.scan(
            self.store.spark, self.root, self.registry.supported_extensions(), tuple(self.ignored)
        )
        report("parse", 2, 3)
        declarations = self._declarations(files)
        report("store", 3, 3)
        self.store.replace_all(self._tables(declarations), self._mark(head))
        return symbols.index_counts(declarations).first().asDict()

    def index_incremental(self, since_commit: str | None = None, progress: Progress | None = None) -> dict[str, int]:
        """Apply what git reports as changed since a commit: committed, staged, unstaged, untracked.

        Without an argument that commit is the one of the last run. Where it is unknown, or HEAD no longer
        descends from it, everything is indexed. The mark moves to HEAD as it was before the listing, in the same
        commit of the store that brings the changes.
        """
        since = since_commit or self.last_commit()
        if not self.git.is_git_repo() or not since or not self.git.has_commit(since):
            return self.index_full(progress)
        report = progress or (lambda *_: None)
        report("changes", 1, 3)
        head = self.git.get_current_commit()
        found = self.git.get_changes_since(since)
        found = found.unionByName(self.git.get_staged_changes()).unionByName(self.git.get_unstaged_changes())
        found = cut(changes.with_untracked(found, self.git.get_untracked_files()), "changes")
        report("parse", 2, 3)
        wanted = changes.paths_to_index(found, tuple(self.ignored))
        declarations = self._declarations(repo_files.not_git_ignored(wanted, self.root))
        report("store", 3, 3)
        removed = changes.removed_paths(found).select(paths.file_id(F.col("path")).alias("file_id"))
        self._replace(removed, declarations, self._mark(head))
        return changes.change_counts(found, symbols.indexed_files(declarations)).first().asDict()

    def apply_events(self, events: DataFrame) -> None:
        """Apply settled events (path, event_type): deleted files go, others are read if they exist."""
        is_deleted = F.col("event_type") == "deleted"
        declarations = self._declarations(events.filter(~is_deleted).select("path").distinct())
        deleted = events.filter(is_deleted).select(paths.file_id(F.col("path")).alias("file_id"))
        self._replace(deleted, declarations)
        self.store.resolve()

    def resolve_references(self) -> int:
        """Turn calls and base classes by name into edges; how many were resolved."""
        return self.store.resolve()

    def last_commit(self) -> str | None:
        """The commit at the end of the last run, to be given to `index_incremental`."""
        return self.store.get_state("commit")

    @staticmethod
    def _mark(commit: str | None) -> dict[str, str]:
        """The fact that is stored in one commit with what was indexed."""
        return {"commit": commit} if commit else {}
