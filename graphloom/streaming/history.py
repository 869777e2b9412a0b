"""Execution history as a stream of start and finish events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finished_runs(events: DataFrame, delay: str = "1 day", within: str = "1 day") -> DataFrame:
    """Starts with their finish, or without one where none comes ``within``: a watermarked outer join.

    events: id, command, at, event (start or finish), outcome. State is dropped once the watermark has passed.
    """
    start = events.where("event = 'start'").select(F.col("id").alias("run"), "command", F.col("at").alias("started_at")).withWatermark("started_at", delay)
    end = events.where("event = 'finish'").select(F.col("id").alias("ended"), F.col("at").alias("finished_at"), "outcome").withWatermark("finished_at", delay)
    when = F.expr(f"run = ended AND finished_at >= started_at AND finished_at <= started_at + interval {within}")
    return start.join(end, when, "left_outer").select(F.col("run").alias("id"), "command", "started_at", "finished_at", F.coalesce("outcome", F.lit("incomplete")).alias("outcome"))


def activity(events: DataFrame, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Events by type in tumbling windows; late ones count until the watermark passes the window."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("window_start"), "event_type", "events", "value")
