"""Whether an analysis still tells of its repository: the ladder, its errors, and one guarded refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .changes import ANALYZER_VERSION, SCHEMA_VERSION

#: One row an event. kind ``analysed``: status, versions and number of errors; ``cached`` and ``seen``: a path's hash in the analysis and in the tree (null: not there).
EVENTS = "repository string, at timestamp, kind string, path string, content_hash string, status string, schema_version int, analyzer_version string, errors int"
#: Reasons for which a refresh may mend an indeterminate state.
RECOVERABLE = ("missing_analysis", "schema_version_mismatch", "analyzer_version_mismatch")


class NotCurrent(RuntimeError):
    """The analysis can't be used; ``code``, ``state`` and ``reason`` say why."""

    code = "OPERATION_BLOCKED"

    def __init__(self, state: str, reason: str = ""):
        super().__init__(f"the analysis is {state}" + (f" ({reason})" if reason else ""))
        self.state, self.reason = state, reason


class MissingAnalysis(NotCurrent):
    code = "MISSING_ANALYSIS"


class StaleAnalysis(NotCurrent):
    code = "STALE_ANALYSIS"


class IncompleteAnalysis(NotCurrent):
    code = "INCOMPLETE_ANALYSIS"


class IndeterminateFreshness(NotCurrent):
    code = "INDETERMINATE_FRESHNESS"


class RefreshFailed(NotCurrent):
    code = "REFRESH_FAILED"


def ladder(rows: DataFrame) -> DataFrame:
    """``rows`` (schema_version, analyzer_version, status, errors, cached, modified, added, deleted) with state and reason; no schema_version: no analysis."""
    n = {c: F.coalesce(c, F.lit(0)) for c in ("cached", "modified", "added", "deleted", "errors")}
    parts = F.array(*(F.when(n[c] > 0, F.concat_ws(" ", n[c].cast("string"), F.lit(c))) for c in ("modified", "added", "deleted")))
    changed = F.concat(F.lit("files changed ("), F.array_join(parts, ", "), F.lit(")"))
    status = F.coalesce("status", F.lit("not_analyzed"))
    done = status.isin("analyzed", "completed")
    unfinished = F.when(status == "failed", "analysis_failed").when(status == "partial", "analysis_partial").otherwise(F.concat(F.lit("analysis_status_"), status))
    rungs: list[tuple[Column, str, Column]] = [
        (F.col("schema_version").isNull(), "indeterminate", F.lit("missing_analysis")),
        (F.col("schema_version") != SCHEMA_VERSION, "indeterminate", F.lit("schema_version_mismatch")),
        (~F.col("analyzer_version").eqNullSafe(ANALYZER_VERSION), "indeterminate", F.lit("analyzer_version_mismatch")),
        ((n["cached"] == 0) & (n["added"] > 0), "indeterminate", F.lit("missing_fingerprints")),
        (n["modified"] + n["added"] + n["deleted"] > 0, "stale", changed),
        (~done, "incomplete", unfinished),
        (n["errors"] > 0, "incomplete", F.concat(n["errors"].cast("string"), F.lit(" analysis errors recorded"))),
    ]
    state, reason = F.lit("current"), F.lit("fresh")
    for when, own, why in reversed(rungs):
        state, reason = F.when(when, own).otherwise(state), F.when(when, why).otherwise(reason)
    return rows.select("*", state.alias("state"), reason.alias("reason"))


def assess(events: DataFrame) -> DataFrame:
    """Per repository of ``events``: state, reason, and the numbers behind them, from the latest event of each kind and path (ties: the greater hash)."""
    last = events.where("kind in ('cached', 'seen')").groupBy("repository", "path").pivot("kind", ["cached", "seen"]).agg(F.max(F.struct("at", "content_hash")))
    a, b = F.col("cached.content_hash"), F.col("seen.content_hash")
    n = lambda c, name: F.count_if(c).alias(name)
    counts = last.groupBy("repository").agg(n(a.isNotNull(), "cached"), n(a != b, "modified"), n(a.isNull() & b.isNotNull(), "added"), n(a.isNotNull() & b.isNull(), "deleted"))
    fields = ("status", "schema_version", "analyzer_version", "errors")
    told = events.where("kind = 'analysed'").groupBy("repository").agg(F.max(F.struct("at", *fields)).alias("m")).select("repository", *(f"m.{f}" for f in fields))
    every = events.select("repository").distinct()
    return ladder(every.join(counts, "repository", "left").join(told, "repository", "left"))


def guarded(assess: Callable[[], tuple[str, str]], refresh: Callable[[], object], load: Callable[[], object], allow_refresh: bool = True):
    """What ``load`` gives, of a current analysis: as it is, or after one refresh.

    ``assess`` gives state and reason. A refresh is tried once, where it is allowed and the state can be mended by it; one
    that fails, or leaves the analysis not current, is RefreshFailed. Otherwise the state has its own error.
    """
    state, reason = assess()
    if state == "current":
        return load()
    if allow_refresh and (state != "indeterminate" or reason in RECOVERABLE):
        try:
            refresh()
        except (OSError, RuntimeError, ValueError) as error:
            raise RefreshFailed(state, str(error)) from error
        state, reason = assess()
        if state != "current":
            raise RefreshFailed(state, reason)
        return load()
    if reason == "missing_analysis":
        raise MissingAnalysis(state, reason)
    raise {"stale": StaleAnalysis, "incomplete": IncompleteAnalysis}.get(state, IndeterminateFreshness)(state, reason)
