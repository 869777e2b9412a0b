"""Freshness as the state of a stream: last hashes of every path, kept by repository and shard.

Each shard of a repository is a key of its own, so that one of a million files isn't one task. Its state
holds the latest cached and seen hash of every path in the state store, not in memory, and four counters that each event
moves; a micro-batch costs its own events. Shard 0 also holds what is known of the analysis. A
repository that is seen without an analysis gets a timer: after ``patience`` of event time, its row says that it waits in vain.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.freshness import ladder

COUNTS = ("cached", "modified", "added", "deleted")
ROW = (
    "repository string, shard int, version bigint, cached bigint, modified bigint, added bigint, deleted bigint, "
    "status string, schema_version int, analyzer_version string, errors int, refresh boolean, overdue boolean"
)
META = "at double, status string, schema_version int, analyzer_version string, errors int"
NO_TIME = float("-inf")


def _counted(cached: str | None, seen: str | None) -> tuple[int, ...]:
    """What a path adds to COUNTS."""
    both = cached is not None and seen is not None
    return int(cached is not None), int(both and cached != seen), int(cached is None and seen is not None), int(cached is not None and seen is None)


def _later(new: tuple[float, str | None], old: tuple[float, str | None]) -> bool:
    """Whether an event replaces another of its path: the later, of equal times the greater hash, and any hash before none."""
    return (new[0], new[1] is not None, new[1] or "") > (old[0], old[1] is not None, old[1] or "")


class Freshness(StatefulProcessor):
    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "cached_at double, cached string, seen_at double, seen string")
        self.totals = handle.getValueState("totals", "version bigint, cached bigint, modified bigint, added bigint, deleted bigint, asked boolean, waiting boolean")
        self.meta = handle.getValueState("meta", META)

    def _row(self, key: tuple, totals: tuple, refresh: bool, overdue: bool) -> pd.DataFrame:
        meta = self.meta.get() if self.meta.exists() else (None, None, None, None, None)
        names = [f.split()[0] for f in ROW.split(", ")]
        return pd.DataFrame([[key[0], key[1], *totals[:5], *meta[1:], refresh, overdue]], columns=names)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, *counts, asked, waiting = self.totals.get() if self.totals.exists() else (0, 0, 0, 0, 0, False, False)
        seen_any, newest = False, NO_TIME
        for chunk in rows:
            chunk = chunk.astype(object).where(chunk.notna(), None)
            for at, kind, path, digest, status, schema, analyzer, errors in zip(chunk["seconds"], chunk["kind"], chunk["path"], chunk["content_hash"], chunk["status"], chunk["schema_version"], chunk["analyzer_version"], chunk["errors"], strict=True):
                newest = max(newest, at)
                if kind == "analysed":
                    new = (at, status, schema, analyzer, errors)
                    known = self.meta.get() if self.meta.exists() else None
                    order = lambda m: (m[0], *((v is not None, v if v is not None else 0) for v in (m[1] or "", m[2], m[3] or "", m[4])))
                    if known is None or order(new) > order(known):
                        self.meta.update((at, status, None if schema is None else int(schema), analyzer, None if errors is None else int(errors)))
                        asked = False
                elif kind in ("cached", "seen") and path is not None:
                    old = self.paths.getValue((path,)) if self.paths.containsKey((path,)) else (NO_TIME, None, NO_TIME, None)
                    slot = 0 if kind == "cached" else 2
                    seen_any |= slot == 2
                    if _later((at, digest), (old[slot], old[slot + 1])):
                        now = list(old)
                        now[slot], now[slot + 1] = at, digest
                        counts = [c - x + y for c, x, y in zip(counts, _counted(old[1], old[3]), _counted(now[1], now[3]), strict=True)]
                        self.paths.updateValue((path,), tuple(now))
        known = self.meta.exists()
        if key[1] == 0 and not known and not waiting and newest > NO_TIME:
            self.handle.registerTimer(int(newest * 1000) + self.patience_ms)
            waiting = True
        stale = sum(counts[1:]) > 0
        refresh, asked = stale and not asked, asked or stale
        totals = (version + 1, *counts, asked, waiting and not known)
        self.totals.update(totals)
        yield self._row(key, totals, refresh, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.totals.exists() and not self.meta.exists():
            version, *rest = self.totals.get()
            totals = (version + 1, *rest)
            self.totals.update(totals)
            yield self._row(key, totals, False, True)

    def close(self) -> None:
        pass


def watch(events: DataFrame, shards: int = 16, delay: str = "1 hour", patience_ms: int = 86_400_000) -> DataFrame:
    """Rows of ``ROW`` from a stream of ``operators.freshness.EVENTS``: one for each shard that a micro-batch touches.

    ``refresh`` is set once when a shard becomes stale, until the next analysis; ``overdue`` when no analysis
    came. Needs the RocksDB state store. The order of events doesn't matter: the latest of a path counts.
    """
    shard = F.when(F.col("kind") == "analysed", 0).otherwise(F.pmod(F.xxhash64("path"), F.lit(shards))).cast("int")
    rows = events.withWatermark("at", delay).withColumns({"shard": shard, "seconds": F.unix_micros("at") / 1e6})
    keyed = rows.groupBy("repository", "shard")
    return keyed.transformWithStateInPandas(Freshness(patience_ms), ROW, "Append", "EventTime")


def assessed(rows: DataFrame) -> DataFrame:
    """State and reason per repository from the rows that ``watch`` has written: the last of each shard, added up."""
    fields = ("status", "schema_version", "analyzer_version", "errors")
    last = rows.groupBy("repository", "shard").agg(F.max_by(F.struct(*COUNTS, *fields), "version").alias("r")).select("repository", "shard", "r.*")
    main = [F.max_by(f, F.when(F.col("shard") == 0, 1)).alias(f) for f in fields]
    return ladder(last.groupBy("repository").agg(*(F.sum(c).alias(c) for c in COUNTS), *main))
