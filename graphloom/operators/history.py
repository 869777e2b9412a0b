"""Execution history, version-control activity, diagnostics and outcomes."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import forget, stored

#: Characters of an error message that are kept; severities from worst to least.
MESSAGE = 500
SEVERITY = ("blocker", "error", "warning", "info")


def latest_runs(events: DataFrame) -> DataFrame:
    """State of each run from its start and finish events.

    events: id, command, repository_path, at, event (start or finish), outcome, error_type, error_message.
    A run without finish stays started; messages are cut to MESSAGE characters.
    """
    start = F.min(F.when(F.col("event") == "start", F.col("at")))
    end = F.max_by(F.struct("at", "outcome", "error_type", F.substring("error_message", 1, MESSAGE).alias("error_message")), F.when(F.col("event") == "finish", F.col("at")))
    done = F.count_if(F.col("event") == "finish") > 0
    rows = events.groupBy("id").agg(F.max("command").alias("command"), F.max("repository_path").alias("repository_path"), start.alias("started_at"), end.alias("e"), done.alias("done"))
    seconds = F.unix_micros(F.col("e.at").cast("timestamp")) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6
    when = lambda c: F.when(F.col("done"), c)
    return rows.select("id", "command", "repository_path", "started_at", when(F.col("e.at")).alias("finished_at"), when(seconds).alias("duration_seconds"), F.coalesce(when(F.col("e.outcome")), F.lit("started")).alias("outcome"), when(F.col("e.error_type")).alias("error_type"), when(F.col("e.error_message")).alias("error_message"))


def recent_runs(runs: DataFrame, repository: str | None = None, limit: int = 10) -> DataFrame:
    """The latest runs by (started_at, id), newest first, with their position."""
    if repository is not None:
        runs = runs.where(F.col("repository_path") == repository)
    top = runs.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("started_at"), F.desc("id"))))


def summarise_commits(changes: DataFrame) -> DataFrame:
    """One row of totals over (commit_hash, author, path, additions, deletions)."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return changes.agg(F.count_distinct("commit_hash").alias("commits"), F.count_distinct("author").alias("authors"), F.count_distinct("path").alias("files_changed"), zero("additions").alias("additions"), zero("deletions").alias("deletions"))


def _below(path: Column, root: str) -> tuple[Column, Column]:
    """(path below ``root``, why there is none): slashes one way, no leading ``./``, no trailing slash; never absolute and never climbing."""
    plain = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", ""), r"(.)/$", "$1")
    escapes = plain.rlike(r"^/|^[A-Za-z]:") | F.array_contains(F.split(plain, "/"), "..")
    if not root:
        return F.when(~escapes, plain), F.when(escapes, F.lit("escapes_root"))
    inside = plain.startswith(root + "/")
    below = F.when(plain == root, F.lit("")).when(inside, plain.substr(F.lit(len(root) + 2), F.char_length(plain)))
    return F.when(~escapes, below), F.when(escapes, F.lit("escapes_root")).when(below.isNull(), F.lit("outside_root"))


def map_paths(status: DataFrame, files: DataFrame, directories: DataFrame, repository_root: str = "/", project_root: str = "/") -> DataFrame:
    """Status rows (path, orig_path) with the entities that they name in the project.

    Adds project_path, match (matched, unmatched, ambiguous; unavailable where the project doesn't lie in the repository),
    entity_id, entity_type, candidates (how many entities have the path), reason, and for renames orig_project_path, orig_match and
    orig_entity_id: the origin never stands in for a new path.
    """
    rel = posixpath.relpath(posixpath.normpath(project_root), posixpath.normpath(repository_root))
    if rel == ".." or rel.startswith("../"):
        null = F.lit(None).cast("string")
        none = {c: null for c in ("project_path", "entity_id", "entity_type", "orig_project_path", "orig_match", "orig_entity_id")}
        return status.withColumns(none | {"match": F.lit("unavailable"), "candidates": F.lit(0).cast("long"), "reason": F.lit("root_reconciliation_failed")})
    plain = lambda df, kind: df.select(_below(F.col("path"), "")[0].alias("at"), F.col("id").alias("entity"), F.lit(kind).alias("type"))
    known = plain(files, "file").unionByName(plain(directories, "directory")).groupBy("at").agg(F.count("*").alias("n"), F.min("entity").alias("entity"), F.min("type").alias("type"))
    root = "" if rel == "." else rel
    own, why = _below(F.col("path"), root)
    rows = status.withColumns({"project_path": own, "why": why, "orig_project_path": F.when(F.col("orig_path").isNotNull(), _below(F.col("orig_path"), root)[0])})
    rows = rows.join(known.withColumnRenamed("at", "project_path"), "project_path", "left")
    origin = known.select(F.col("at").alias("orig_project_path"), F.col("n").alias("orig_n"), F.col("entity").alias("orig_entity"))
    rows = rows.join(origin, "orig_project_path", "left")
    state = lambda n: F.when(F.coalesce(n, F.lit(0)) == 0, "unmatched").when(n == 1, "matched").otherwise("ambiguous")
    return rows.select(
        *status.columns, "project_path", state(F.col("n")).alias("match"), F.when(F.col("n") == 1, F.col("entity")).alias("entity_id"), F.when(F.col("n") == 1, F.col("type")).alias("entity_type"),
        F.coalesce("n", F.lit(0)).alias("candidates"), F.coalesce("why", F.when(F.col("n").isNull(), "no_entity")).alias("reason"), "orig_project_path",
        F.when(F.col("orig_project_path").isNotNull(), state(F.col("orig_n"))).alias("orig_match"), F.when(F.col("orig_n") == 1, F.col("orig_entity")).alias("orig_entity_id"),
    )


def mapping_counts(mapped: DataFrame) -> DataFrame:
    """One row: matched, unmatched, ambiguous, unavailable, and outcome: success where all rows match, blocked where roots can't be reconciled, else partial."""
    n = lambda m: F.count_if(F.col("match") == m)
    rows = mapped.agg(F.count("*").alias("total"), *(n(m).alias(m) for m in ("matched", "unmatched", "ambiguous", "unavailable")))
    outcome = F.when(F.col("unavailable") > 0, "blocked").when((F.col("matched") == F.col("total")) & (F.col("total") > 0), "success").otherwise("partial")
    return rows.withColumn("outcome", outcome)


def paths_today(changes: DataFrame) -> DataFrame:
    """``changes`` (ordinal, path, old_path, status) with current_path: what the file of that change is called after the last one.

    A path holds from one rename or deletion to the next: a change belongs to the first such event of its path after it
    (a rename itself to the first one of its new path), and that event to the next of the path that it makes. Events are linked to their last by doubling,
    so chains of renames cost the logarithm of their length. A deleted file has no path today.
    """
    events = changes.where(F.col("status").isin("R", "D")).select(F.col("ordinal").alias("at"), F.when(F.col("status") == "R", F.col("old_path")).otherwise(F.col("path")).alias("of"), F.when(F.col("status") == "R", F.col("path")).alias("to")).distinct()

    def first_after(rows: DataFrame, path: str, at: str, keys: list[str]) -> DataFrame:
        """keys, e: the first event of ``path`` after ``at``."""
        met = rows.join(events, (F.col(path) == F.col("of")) & (F.col("at") > F.col(at)))
        return met.groupBy(*keys).agg(F.min(F.struct("at", "of", "to")).alias("e"))

    named = events.select(F.col("at").alias("event_at"), F.col("of").alias("event_of"), F.col("to").alias("event_to"))
    onward = first_after(named, "event_to", "event_at", ["event_at", "event_of"])
    now = stored(named.join(onward, ["event_at", "event_of"], "left").select("event_at", "event_of", F.col("event_to").alias("last"), F.col("e.at").alias("next_at"), F.col("e.of").alias("next_of")))
    while not now.where("next_at is not null").isEmpty():
        ahead = now.select(F.col("event_at").alias("next_at"), F.col("event_of").alias("next_of"), F.col("last").alias("far"), F.col("next_at").alias("far_at"), F.col("next_of").alias("far_of"), F.lit(True).alias("met"))
        # A file that was deleted further on has no path, so what is met decides, null or not.
        after = stored(now.join(ahead, ["next_at", "next_of"], "left").select("event_at", "event_of", F.when(F.col("met"), F.col("far")).otherwise(F.col("last")).alias("last"), F.col("far_at").alias("next_at"), F.col("far_of").alias("next_of")))
        forget(now)
        now = after
    gone = F.col("status") == "D"
    keyed = changes.select("ordinal", "path").distinct()
    first = first_after(keyed, "path", "ordinal", ["ordinal", "path"]).select("ordinal", "path", F.col("e.at").alias("event_at"), F.col("e.of").alias("event_of"))
    final = first.join(now.select("event_at", "event_of", "last"), ["event_at", "event_of"]).select("ordinal", "path", "last", F.lit(True).alias("moved"))
    return changes.join(final, ["ordinal", "path"], "left").select(*changes.columns, F.when(~gone, F.when(F.col("moved"), F.col("last")).otherwise(F.col("path"))).alias("current_path"))


def outcomes(diagnostics: DataFrame, by: list[str]) -> DataFrame:
    """Status and severity counts for each ``by``: an error fails, a blocker blocks, then incomplete, partial (warnings), success."""
    count = lambda s: F.count_if(F.col("severity") == s)
    rows = diagnostics.groupBy(*by).agg(*[count(s).alias(f"{s}s") for s in SEVERITY], F.coalesce(F.bool_or("incomplete"), F.lit(False)).alias("incomplete"))
    status = F.when(F.col("errors") > 0, "failed").when(F.col("blockers") > 0, "blocked").when(F.col("incomplete"), "incomplete").when(F.col("warnings") > 0, "partial").otherwise("success")
    return rows.withColumn("status", status)


def first_of_each(rows: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def parse_errors(errors: DataFrame) -> DataFrame:
    """Messages like ``path:line:column: text`` or ``no parser …: path`` as path, line, column, code, text."""
    located = r"^(.+?):(\d+)(?::(\d+))?:\s*(.*)$"
    part = lambda i: F.nullif(F.regexp_extract("message", located, i), F.lit(""))
    missing = F.lower("message").rlike("no parser")
    path = F.coalesce(part(1), F.when(missing, F.nullif(F.regexp_extract("message", r"(\S+\.\w+)\W*$", 1), F.lit(""))))
    return errors.select("ordinal", "message", path.alias("path"), part(2).cast("int").alias("line"), part(3).cast("int").alias("column"), F.when(missing, "no_parser").when(part(2).isNotNull(), "parse_error").otherwise("analysis_error").alias("code"), F.coalesce(part(4), "message").alias("text"))
