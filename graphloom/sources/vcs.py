"""Version control: repository facts, commit log, working-tree status."""

from __future__ import annotations

import datetime
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RECORD, FIELD = "\x1e", "\x1f"
COMMITS = (
    "ordinal bigint, commit_hash string, author string, at timestamp, parents array<string>, message string, "
    "changes array<struct<path: string, old_path: string, status: string, additions: bigint, deletions: bigint>>"
)
STATUS = "path string, index_status string, working_tree_status string, orig_path string"
STATUS_TIMEOUT = 15


def run(root: str, *args: str, timeout: float | None = None) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout, errors="replace")
    if done.returncode:
        raise RuntimeError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def is_repository(root: str) -> bool:
    try:
        return run(root, "rev-parse", "--is-inside-work-tree").strip() == "true"
    except (RuntimeError, OSError):
        return False


def info(root: str) -> dict:
    """root, head and branch; a detached head has no branch, an empty repository no head."""
    def ask(*args: str) -> str | None:
        try:
            return run(root, *args).strip() or None
        except RuntimeError:
            return None

    branch = ask("symbolic-ref", "--short", "-q", "HEAD")
    return {"root": ask("rev-parse", "--show-toplevel"), "head": ask("rev-parse", "-q", "--verify", "HEAD"), "branch": branch}


def _log(root: str, *args: str) -> Iterator[tuple]:
    """Rows of ``COMMITS`` but the ordinal, newest first, read record by record from one process.

    Names are NUL-terminated, so no path needs unquoting; a rename or copy has its old path and, unlike line counts looked
    up by the new path alone, its own counts. Merges have no changes.
    """
    shape = "%x1e" + "%x1f".join(("%H", "%an", "%at", "%P", "%s")) + "%x1f"
    with subprocess.Popen(["git", "-C", root, "log", "-z", "--root", "-M", "--raw", "--numstat", f"--format={shape}", *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE) as log:
        held = b""
        while chunk := log.stdout.read(1 << 16):
            *whole, held = (held + chunk).split(RECORD.encode())
            yield from (_commit(r) for r in whole if r.strip(b"\0\n"))
        if held.strip(b"\0\n"):
            yield _commit(held)
        if log.wait():
            said = log.stderr.read().decode("utf-8", "replace").strip()
            if "does not have any commits yet" not in said and "unknown revision" not in said:
                raise RuntimeError(said or "git log failed")


def _commit(record: bytes) -> tuple:
    *head, tail = record.decode("utf-8", "replace").split(FIELD, 5)
    parts = iter([p.lstrip("\n") for p in tail.split("\0")])
    kinds, counts = {}, {}
    for part in parts:
        if part.startswith(":"):
            kind, first = part.rsplit(" ", 1)[1][0], next(parts)
            old, path = (first, next(parts)) if kind in "RC" else (None, first)
            kinds[path] = (old, kind)
        elif part.count("\t") >= 2:
            added, gone, path = part.split("\t", 2)
            if not path:
                path = (next(parts), next(parts))[1]
            counts[path] = tuple(int(n) if n.isdigit() else 0 for n in (added, gone))
    changes = [{"path": p, "old_path": old, "status": kind, "additions": counts.get(p, (0, 0))[0], "deletions": counts.get(p, (0, 0))[1]} for p, (old, kind) in kinds.items()]
    own, author, at, parents, message = head
    return own, author, datetime.datetime.fromtimestamp(int(at), datetime.UTC), parents.split(), message, changes


@dataclass
class Range(InputPartition):
    """Commits ``skip`` to ``skip + count`` of what ``revisions`` lists, newest first, the last of which has the ordinal ``base``."""

    revisions: str
    skip: int
    count: int
    base: int


def _count(root: str, revisions: str) -> int:
    try:
        return int(run(root, "rev-list", "--count", revisions))
    except RuntimeError:
        return 0


def _ranges(root: str, revisions: str, base: int, size: int, limit: int | None = None) -> list[Range]:
    every = _count(root, revisions)
    wanted = every if limit is None else min(limit, every)
    return [Range(revisions, at, min(size, wanted - at), base + every - 1) for at in range(0, wanted, size)]


def _rows(root: str, part: Range) -> Iterator[tuple]:
    for i, row in enumerate(_log(root, f"--skip={part.skip}", f"--max-count={part.count}", part.revisions)):
        yield (part.base - part.skip - i, *row)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size = options["path"], int(options.get("commits_per_partition", 1000))
        self.limit = int(options["limit"]) if options.get("limit") else None
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit must be positive")

    def partitions(self) -> list[Range]:
        head = info(self.root)["head"]
        return (_ranges(self.root, head, 0, self.size, self.limit) if head else []) or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from _rows(self.root, partition) if partition.count else ()


class _StreamReader(DataSourceStreamReader):
    """Offsets are heads: a batch holds the commits that one head has and the last one had not."""

    def __init__(self, options: dict):
        self.root, self.size = options["path"], int(options.get("commits_per_partition", 1000))

    def initialOffset(self) -> dict:
        return {"head": ""}

    def latestOffset(self) -> dict:
        return {"head": info(self.root)["head"] or ""}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if not end["head"]:
            return []
        revisions = f"{start['head']}..{end['head']}" if start["head"] else end["head"]
        return _ranges(self.root, revisions, _count(self.root, start["head"]) if start["head"] else 0, self.size)

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from _rows(self.root, partition)


class CommitLog(DataSource):
    """``spark.read.format("commit_log").load(path)``, or ``readStream``: one row a commit.

    Options: ``limit`` newest commits (batch), ``commits_per_partition``. Each partition is a range of commits that a worker reads from a
    process of its own, so ``path`` must lie where workers see it. ``ordinal`` counts commits from the oldest, 0.
    """

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return COMMITS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def commits(spark: SparkSession, root: str, limit: int | None = None, **options) -> DataFrame:
    """The commit log of a repository; an empty one has no rows."""
    spark.dataSource.register(CommitLog)
    reader = spark.read.format("commit_log").options(**options)
    return (reader if limit is None else reader.option("limit", limit)).load(root)


def changes(found: DataFrame) -> DataFrame:
    """One row for each changed path; commits without changes keep one row with a null path."""
    return found.select("commit_hash", "ordinal", "author", "at", F.explode_outer("changes").alias("c")).select("commit_hash", "ordinal", "author", "at", "c.*")


def parse_status(text: str) -> list[tuple]:
    """Rows of a NUL-separated porcelain status; a rename or copy takes the next record as its old path."""
    out, parts = [], iter(text.split("\0"))
    for part in parts:
        if not part:
            continue
        if len(part) < 4 or part[2] != " ":
            raise ValueError(f"malformed status record {part!r}")
        old = None
        if part[0] in "RC" or part[1] in "RC":
            old = next(parts, None)
            if not old:
                raise ValueError(f"status record {part!r} lacks its old path")
        out.append((part[3:], part[0], part[1], old))
    return out


def status(spark: SparkSession, root: str, untracked: str = "all", timeout: float = STATUS_TIMEOUT) -> DataFrame:
    """Status rows with what they mean: staged, unstaged, untracked, ignored, conflicted, deleted, renamed, added."""
    rows = spark.createDataFrame(parse_status(run(root, "status", "--porcelain=v1", "-z", f"--untracked-files={untracked}", timeout=timeout)), STATUS)
    x, y = F.col("index_status"), F.col("working_tree_status")
    clash = F.concat(x, y).isin("DD", "AU", "UD", "UA", "DU", "AA", "UU")
    return rows.withColumns({
        "is_untracked": x == "?", "is_ignored": x == "!", "is_conflicted": clash, "is_staged": ~x.isin(" ", "?", "!") & ~clash, "is_unstaged": ~y.isin(" ", "?", "!") & ~clash,
        "is_deleted": (x == "D") | (y == "D"), "is_renamed": x.isin("R", "C") | y.isin("R", "C"), "is_added": x == "A",
    })
