"""Changes of a git work tree.

Git answers from one process, so its output is taken on the driver; it holds one line per changed
file of one repository. The lines themselves are parsed as a DataFrame.
"""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession

from codeskein.operators import changes


class GitError(RuntimeError):
    """Git could not answer. A failure is never taken for "no changes"."""


class GitTracker:
    """Outside a work tree there are no changes; inside one a command that fails raises `GitError`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root)

    def _git(self, *args: str) -> str:
        if not self.is_git_repo():
            return ""
        try:
            done = subprocess.run(["git", *args], cwd=self.root, capture_output=True)
        except OSError as error:
            raise GitError(f"git {args[0]}: {error}") from error
        if done.returncode:
            raise GitError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
        return done.stdout.decode(errors="surrogateescape").encode(errors="replace").decode()

    def _paths(self, *args: str) -> DataFrame:
        found = [(path,) for path in self._git(*args, "-z").split("\0") if path]
        return self.spark.createDataFrame(found, "path string")

    def _changes(self, *args: str) -> DataFrame:
        """Names come apart by NUL, so that no character of a name needs quoting."""
        parts = iter(self._git("diff", "--name-status", "-z", *args).split("\0"))
        rows = []
        for status in parts:
            if status:
                rows.append((status, next(parts), next(parts) if status[0] in "RC" else None))
        return changes.from_fields(self.spark.createDataFrame(rows, "status string, first string, second string"))

    def is_git_repo(self) -> bool:
        return os.path.exists(os.path.join(self.root, ".git"))

    def get_current_commit(self) -> str | None:
        """None outside a work tree and before the first commit."""
        if self.is_git_repo() and not self._git("rev-list", "-n", "1", "--all").strip():
            return None
        return self._git("rev-parse", "HEAD").strip() or None

    def has_commit(self, commit: str) -> bool:
        """Whether the commit is an ancestor of HEAD, so that changes since it can be listed."""
        done = subprocess.run(["git", "merge-base", "--is-ancestor", commit, "HEAD"], cwd=self.root, capture_output=True)
        return done.returncode == 0

    def get_changes_since(self, commit: str) -> DataFrame:
        return self._changes(commit, "HEAD")

    def get_staged_changes(self) -> DataFrame:
        return self._changes("--cached")

    def get_unstaged_changes(self) -> DataFrame:
        return self._changes()

    def get_untracked_files(self) -> DataFrame:
        return self._paths("ls-files", "--others", "--exclude-standard")

    def get_all_tracked_files(self) -> DataFrame:
        return self._paths("ls-files")

    def is_ignored(self, path: str) -> bool:
        if not self.is_git_repo():
            return False
        done = subprocess.run(["git", "check-ignore", "-q", path], cwd=self.root, capture_output=True)
        if done.returncode > 1:
            raise GitError(f"git check-ignore: {done.stderr.decode(errors='replace').strip()}")
        return done.returncode == 0
