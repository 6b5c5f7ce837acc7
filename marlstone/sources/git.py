"""Git repositories as data sources.

Only plumbing output is read, under an isolated configuration: no hooks, no
filters, no external diff, no system or user settings.  Work is dealt out by
ranges of commits or by top-level folders; each task runs git on its part.  The
repository must be on a path that all executors see.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marlstone.functions.paths import in_scope, safe_path
from marlstone.functions.stage import import_on_workers
from marlstone.operators import changes

COMMITS_PER_TASK = 2_000
#: Largest file whose bytes a worktree listing reads.
WORKTREE_BYTES = 1 << 20
_FIELDS = "%H%x1f%s%x1f%B%x1f%an%x1f%ae%x1f%at%x1f%ct%x1f%P%x1e"


def git(repository: str, *args: str, given: str | None = None) -> str:
    """Output of a git command under an isolated configuration."""
    env = {"PATH": os.environ.get("PATH", ""), "HOME": "/nonexistent", "GIT_CONFIG_NOSYSTEM": "1", "GIT_CONFIG_GLOBAL": os.devnull, "GIT_TERMINAL_PROMPT": "0", "GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C.UTF-8"}
    command = ["git", "-c", "core.hooksPath=/dev/null", "-c", "core.fsmonitor=false", "-c", f"safe.directory={os.path.realpath(repository)}", "-C", repository, *args]
    return subprocess.run(command, env=env, input=given, capture_output=True, text=True, encoding="utf-8", errors="replace", check=True).stdout


def discover(directory: str) -> str:
    """The worktree that holds a directory; symbolic links are refused."""
    if os.path.islink(directory) or not os.path.isdir(directory):
        raise ValueError(f"{directory} is no directory")
    return git(directory, "rev-parse", "--show-toplevel").strip()


def scope_of(repository: str, directory: str) -> str:
    """A directory as a scope inside its repository."""
    base = os.path.realpath(repository)
    inside = os.path.relpath(os.path.abspath(directory), base)
    if inside.startswith(".."):
        inside = os.path.relpath(os.path.abspath(directory), os.path.abspath(repository))
    if inside.startswith(".."):
        raise ValueError(f"{directory} lies outside {repository}")
    at = base
    for part in inside.split("/"):
        at = os.path.join(at, part)
        if os.path.islink(at):
            raise ValueError(f"{at} is a symbolic link")
    return inside


class _Part(InputPartition):
    def __init__(self, values: list[str]):
        self.values = values


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rev = options["path"], options.get("rev", "HEAD")
        self.most = int(options["most"]) if "most" in options else None


class _LogReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        ids = git(self.path, "rev-list", "--date-order", *([f"--max-count={self.most}"] if self.most is not None else []), self.rev).split()
        return [_Part(ids[k : k + COMMITS_PER_TASK]) for k in range(0, len(ids), COMMITS_PER_TASK)] or [_Part([])]


class CommitReader(_LogReader):
    def read(self, partition: _Part) -> Iterator[tuple]:
        if not partition.values:
            return
        out = git(self.path, "log", "--no-walk=unsorted", "--no-show-signature", "--stdin", f"--format={_FIELDS}", given="\n".join(partition.values))
        for record in out.split("\x1e"):
            if record.strip():
                sha, subject, message, name, email, authored, committed, parents = record.strip("\n").split("\x1f")
                yield sha, subject, message.rstrip("\n"), name, email, int(authored), int(committed), len(parents.split()) > 1


class CommitSource(DataSource):
    """``git_log``: commits reachable from ``rev``, newest first by number of tasks."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "id string, subject string, message string, author_name string, author_email string, author_seconds long, committer_seconds long, is_merge boolean"

    def reader(self, schema) -> DataSourceReader:
        return CommitReader(self.options)


class CommitPathReader(_LogReader):
    def read(self, partition: _Part) -> Iterator[tuple]:
        if not partition.values:
            return
        # Merges print nothing without -m; the first commit is compared with the empty tree.
        out = git(self.path, "diff-tree", "--stdin", "-r", "-z", "--root", "--no-renames", "--no-ext-diff", "--no-textconv", "--name-only", given="\n".join(partition.values) + "\n")
        known, now = set(partition.values), None
        for item in out.split("\0"):
            head, _, rest = item.partition("\n")
            for x in (item,) if head not in known else (head, rest):
                if x in known:
                    now = x
                elif x and now:
                    yield now, x


class CommitPathSource(DataSource):
    """``git_paths``: paths that each commit changed against its first parent; merges have none."""

    @classmethod
    def name(cls) -> str:
        return "git_paths"

    def schema(self) -> str:
        return "id string, path string"

    def reader(self, schema) -> DataSourceReader:
        return CommitPathReader(self.options)


class TreeReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        top = [x.partition("\t")[2] for x in git(self.path, "ls-tree", "-z", "--full-tree", self.rev).split("\0") if x]
        return [_Part(top[k : k + 64]) for k in range(0, len(top), 64)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if not partition.values:
            return
        for line in git(self.path, "ls-tree", "-r", "-z", "-l", "--full-tree", self.rev, "--", *partition.values).split("\0"):
            if line:
                facts, _, path = line.partition("\t")
                mode, kind, oid, size = facts.split()
                yield path, oid, mode, kind, None if size == "-" else int(size)


class TreeSource(DataSource):
    """``git_tree``: the files of a revision; submodules have kind ``commit``."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "path string, oid string, mode string, kind string, size long"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


class WorktreeReader(_Reader):
    """Files by top-level names: what the walk finds, and which of them git doesn't ignore."""

    def __init__(self, options):
        super().__init__(options)
        self.max_bytes, self.recursive = int(options.get("max_bytes", WORKTREE_BYTES)), options.get("recursive", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        top = sorted(x for x in os.listdir(self.path) if x != ".git")
        return [_Part(top[k : k + 16]) for k in range(0, len(top), 16)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if not partition.values:
            return
        listed = git(self.path, "ls-files", "-z", "--cached", "--others", "--exclude-standard", "--", *(f":(literal){x}" for x in partition.values)).split("\0")
        visible = set(listed)
        stack = sorted(partition.values, reverse=True)
        while stack:
            path = stack.pop()
            whole = os.path.join(self.path, path)
            try:
                facts = os.lstat(whole)
                if os.path.islink(whole):
                    yield path, facts.st_size, "symlink", path in visible, None
                elif os.path.isdir(whole):
                    inner = sorted(os.listdir(whole), reverse=True)
                    nested = ".git" in inner
                    if nested:
                        yield path, None, "nested_repository", True, None
                    if not nested or self.recursive:
                        stack += [f"{path}/{x}" for x in inner if x != ".git"]
                elif os.path.isfile(whole):
                    content = None
                    if facts.st_size <= self.max_bytes:
                        with open(whole, "rb") as f:
                            content = f.read(self.max_bytes + 1)
                    seen = path in visible or (self.recursive and any(path.startswith(v) for v in listed if v.endswith("/")))
                    yield path, facts.st_size, "file", seen, content
            except OSError:
                yield path, None, "unreadable", path in visible, None


class WorktreeSource(DataSource):
    """``git_worktree``: everything under a worktree but git's own folders, dot names too; links aren't followed, nested repositories are named and, unless ``recursive``, not entered."""

    @classmethod
    def name(cls) -> str:
        return "git_worktree"

    def schema(self) -> str:
        return "path string, size long, kind string, visible boolean, content binary"

    def reader(self, schema) -> DataSourceReader:
        return WorktreeReader(self.options)


class IndexReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        return [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for line in git(self.path, "ls-files", "-z", "--stage").split("\0"):
            if line:
                facts, _, path = line.partition("\t")
                mode, oid, _ = facts.split()
                yield path, oid, mode


class IndexSource(DataSource):
    """``git_index``: the paths of the index."""

    @classmethod
    def name(cls) -> str:
        return "git_index"

    def schema(self) -> str:
        return "path string, oid string, mode string"

    def reader(self, schema) -> DataSourceReader:
        return IndexReader(self.options)


def register(spark: SparkSession) -> None:
    import_on_workers(spark)
    for source in (CommitSource, CommitPathSource, TreeSource, WorktreeSource, IndexSource):
        spark.dataSource.register(source)


def read_git(spark: SparkSession, source: str, repository: str, **options) -> DataFrame:
    """One of the sources above over a repository."""
    register(spark)
    return spark.read.format(source).options(path=repository, **{k: str(v) for k, v in options.items()}).load()


def commit_summary(repository: str, rev: str = "HEAD", most: int | None = None) -> dict:
    """How many commits there are, and how many a reader with ``most`` gives."""
    total = int(git(repository, "rev-list", "--count", rev))
    returned = total if most is None else min(total, most)
    return {"total": total, "returned": returned, "truncated": returned < total}


def revision_ends(base: str | None = None, head: str | None = None, revisions: str | None = None) -> tuple[str, str]:
    """The two revisions to compare: of a range ``a..b``, or a base and a head; an end left out is HEAD."""
    if revisions is not None:
        if "..." in revisions or revisions.count("..") != 1 or base is not None or head is not None:
            raise ValueError("give a range a..b, or a base and a head")
        base, head = revisions.split("..")
    return base or "HEAD", head or "HEAD"


def resolve_changes(spark: SparkSession, repository: str, base: str | None = None, head: str | None = None, revisions: str | None = None, dirty: bool = False, scope: str = ".", most: int = 4096) -> tuple[DataFrame, DataFrame]:
    """``(kind, path, previous_path)`` between two revisions and, if asked, of the dirty worktree, and ``(reason, detail)`` of what is uncertain."""
    parts, trees = [], lambda rev: read_git(spark, "git_tree", repository, rev=rev).filter("kind = 'blob'").filter(in_scope(F.col("path"), scope)).select("path", "oid")
    if base is not None or head is not None or revisions is not None:
        a, b = revision_ends(base, head, revisions)
        for rev in (a, b):
            git(repository, "rev-parse", "--verify", "--end-of-options", f"{rev}^{{commit}}")
        parts.append(changes.detect_renames(changes.tree_diff(trees(a), trees(b))).select("kind", "path", "previous_path"))
    if dirty:
        index = read_git(spark, "git_index", repository).filter(in_scope(F.col("path"), scope)).select("path", "oid")
        now = read_git(spark, "git_worktree", repository).filter("kind = 'file' and visible").filter(in_scope(F.col("path"), scope))
        # A blob's name is a digest of a header and its bytes; a file too large to be read counts as changed.
        oid = F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length("content").cast("string"), F.lit("\0")).cast("binary"), F.col("content")))
        found = changes.tree_diff(index, now.select("path", F.coalesce(oid, F.lit("unread")).alias("oid")))
        parts.append(found.select(F.when(F.col("kind") == "added", "untracked").otherwise(F.col("kind")).alias("kind"), "path", F.lit(None).cast("string").alias("previous_path")))
    if not parts:
        return spark.createDataFrame([], "kind string, path string, previous_path string"), spark.createDataFrame([], "reason string, detail string")
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return changes.bounded_changes(every, most)


def blob_lines(spark: SparkSession, repository: str, path: str, most: int = 1 << 20) -> DataFrame:
    """Lines of a small file of HEAD as ``value``; none if it isn't there or is larger than ``most`` bytes."""
    listed = git(repository, "ls-tree", "-l", "--full-tree", "HEAD", "--", path).split()
    small = len(listed) >= 4 and listed[3].isdigit() and int(listed[3]) <= most
    text = git(repository, "cat-file", "blob", listed[2]) if small else ""
    return spark.createDataFrame([(line,) for line in text.splitlines()], "value string")


def mailmap(lines: DataFrame) -> DataFrame:
    """``(name, email, raw_name, raw_email)`` of the lines of a mailmap; lines of one address rename it."""
    lines = lines.select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("v")).filter("v <> ''")
    two = r"^(.*?)\s*<([^>]*)>\s*(.*?)\s*<([^>]*)>$"
    one = r"^(.*?)\s*<([^>]*)>$"
    pair = F.col("v").rlike(two)
    part = lambda i, j: F.nullif(F.when(pair, F.regexp_extract("v", two, i)).otherwise(F.regexp_extract("v", one, j)), F.lit(""))
    raw_name = F.when(pair, F.nullif(F.regexp_extract("v", two, 3), F.lit("")))
    return lines.select(part(1, 1).alias("name"), part(2, 2).alias("email"), raw_name.alias("raw_name"), part(4, 2).alias("raw_email"))


def submodules(lines: DataFrame) -> DataFrame:
    """Paths that the lines of a submodule file declare."""
    found = lines.select(F.regexp_extract("value", r"^\s*path\s*=\s*(.+?)\s*$", 1).alias("path"))
    return found.filter((F.col("path") != "") & safe_path(F.col("path"))).distinct()
