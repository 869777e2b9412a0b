"""The freshness ladder, its guard, and the stream against the batch."""

import pytest
from graphloom.operators import freshness as ladder
from graphloom.plans import text_queries
from graphloom.streaming import freshness
from pyspark.sql import functions as F


def events(spark, rows):
    full = [(r, at, kind, path, digest, *(more or (None, None, None, None))) for r, at, kind, path, digest, more in rows]
    return spark.createDataFrame(full, ladder.EVENTS.replace("at timestamp", "at string")).withColumn("at", F.to_timestamp("at"))


def test_ladder_by_rungs(spark):
    at, ok = "2024-01-01 00:00:00", ("analyzed", 2, "0.1.0", 0)
    pair = lambda r, a, b: [(r, at, "cached", "p", a, None), (r, at, "seen", "p", b, None)]
    rows = pair("current", "h", "h") + pair("changed", "h", "i") + pair("old", "h", "h") + pair("other", "h", "h") + pair("bare", None, "h") + pair("partial", "h", "h") + pair("errors", "h", "h") + pair("both", "h", None) + pair("none", "h", "h")
    meta = {"current": ok, "changed": ok, "old": ("analyzed", 1, "0.1.0", 0), "other": ("analyzed", 2, "0.0.9", 0), "bare": ok, "partial": ("partial", 2, "0.1.0", 0), "errors": ("completed", 2, "0.1.0", 3), "both": ("failed", 2, "0.1.0", 3)}
    rows += [(r, at, "analysed", None, None, m) for r, m in meta.items()] + [("current", "2023-01-01 00:00:00", "analysed", None, None, ("failed", 1, "0", 9)), ("current", "2023-01-01 00:00:00", "seen", "p", "x", None)]
    got = {r.repository: (r.state, r.reason) for r in ladder.assess(events(spark, rows)).collect()}
    assert got == {
        "current": ("current", "fresh"), "changed": ("stale", "files changed (1 modified)"), "old": ("indeterminate", "schema_version_mismatch"), "other": ("indeterminate", "analyzer_version_mismatch"), "bare": ("indeterminate", "missing_fingerprints"),
        "partial": ("incomplete", "analysis_partial"), "errors": ("incomplete", "3 analysis errors recorded"), "both": ("stale", "files changed (1 deleted)"), "none": ("indeterminate", "missing_analysis"),
    }


def test_guard_refreshes_once():
    def guard(states, allow=True, fail=None):
        left, done = list(states), []

        def refresh():
            done.append(1)
            if fail:
                raise fail

        try:
            return ladder.guarded(lambda: left.pop(0), refresh, lambda: "loaded", allow), len(done)
        except ladder.NotCurrent as error:
            return error.code, len(done)

    stale, fresh = ("stale", "files changed (1 added)"), ("current", "fresh")
    assert guard([fresh]) == ("loaded", 0) and guard([stale, fresh]) == ("loaded", 1)
    assert guard([stale, stale]) == ("REFRESH_FAILED", 1) and guard([stale], fail=RuntimeError("x")) == ("REFRESH_FAILED", 1)
    assert guard([stale], False) == ("STALE_ANALYSIS", 0) and guard([("incomplete", "analysis_failed")], False) == ("INCOMPLETE_ANALYSIS", 0)
    assert guard([("indeterminate", "missing_analysis")], False) == ("MISSING_ANALYSIS", 0) and guard([("indeterminate", "missing_analysis"), fresh]) == ("loaded", 1)
    assert guard([("indeterminate", "missing_fingerprints")]) == ("INDETERMINATE_FRESHNESS", 0)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def run(spark, tmp_path, batches, **more):
    """The rows that the stream writes over batches given one after another."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = freshness.watch(spark.readStream.schema(rows.schema).parquet(source), **more)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination(120)
    return spark.read.schema(freshness.ROW).parquet(out)


def test_stream_equals_batch_whatever_the_order(rocks, tmp_path):
    every = text_queries.freshness_events(rocks, "/root/testdata/sf0.001").select(*(f.split()[0] for f in ladder.EVENTS.split(", "))).where("repository in ('r0', 'r1', 'r2', 'r3', 'r7', 'r8')")
    parts = [every.where(F.pmod(F.xxhash64("at", "path"), F.lit(3)) == k) for k in range(3)]
    rows = run(rocks, tmp_path, parts, shards=3, delay="60 days")
    want = {r.repository: (r.state, r.reason) for r in ladder.assess(every).collect()}
    assert {r.repository: (r.state, r.reason) for r in freshness.assessed(rows).collect()} == want and len(want) > 3


def test_stream_asks_for_one_refresh_and_waits_in_vain_once(rocks, tmp_path):
    ok, day = ("analyzed", 2, "0.1.0", 0), lambda n: f"2024-01-{n:02d} 00:00:00"
    batches = [
        [("a", day(1), "analysed", None, None, ok), ("a", day(1), "cached", "p", "h", None), ("a", day(1), "seen", "p", "h", None), ("b", day(1), "seen", "q", "h", None)],
        [("a", day(5), "seen", "p", "i", None)],
        [("a", day(6), "seen", "p", "j", None)],
        [("a", day(7), "analysed", None, None, ok), ("a", day(7), "cached", "p", "j", None)],
        [("a", day(9), "seen", "p", "k", None)],
    ]
    rows = run(rocks, tmp_path, [events(rocks, b) for b in batches], shards=1, delay="1 hour").orderBy("version").collect()
    assert [(r.version, r.refresh) for r in rows if r.repository == "a"] == [(1, False), (2, True), (3, False), (4, False), (5, True)]
    assert [r.overdue for r in rows if r.repository == "b"] == [False, True]
