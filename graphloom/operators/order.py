"""Positions in one global order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, few


def positions(df: DataFrame, *order, column: str = "position") -> DataFrame:
    """``df`` with the place of each row by ``order``, from 1.

    Rows are sorted over all partitions; a row's place is the number of rows in the ranges before its own
    (one count a partition) and its place in it. The order should be total.
    """
    placed = checkpoint(df.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.withColumn("_own", own).join(F.broadcast(offsets), "_range").withColumn(column, (F.col("_own") + F.col("_offset")).cast("int")).drop("_range", "_own", "_offset")


#: A key of more rows than this is placed by ranges; one task sorts those of any other.
HUB = 200_000


def positions_within(df: DataFrame, key: str, *order, column: str = "position", hub: int = HUB) -> DataFrame:
    """``df`` with the place of each row among those of its ``key`` by ``order``, from 1, without one task for all rows of a key.

    Keys are counted first (``df`` is computed for that as well). Rows of keys up to ``hub`` are ranked where a shuffle by key puts them;
    those of larger ones are placed by ranges. The order should be total.
    """
    counts = df.groupBy(F.col(key).alias("_hub")).agg(F.count("*").alias("_n"))
    hubs = checkpoint(counts.where(F.col("_n") > hub).select("_hub"))
    n = hubs.count()
    ranked = lambda rows: rows.withColumn(column, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("int"))
    if not n:
        return ranked(df)
    large, on = few(hubs, n), F.col(key).eqNullSafe(F.col("_hub"))
    return ranked(df.join(large, on, "left_anti")).unionByName(_placed_by_ranges(df.join(large, on, "left_semi"), key, *order, column=column))


def _placed_by_ranges(df: DataFrame, key: str, *order, column: str) -> DataFrame:
    """Rows are sorted by key and order over all partitions, so a key with half of all rows lies in many ranges. A row's place is the
    number of its key's rows in earlier ranges (one count for each range and key) and its place in its own."""
    placed = checkpoint(df.orderBy(key, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(key, "_range").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_range", key).orderBy(*order))
    ranked = placed.withColumn("_own", own).join(offsets.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), "_offset"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    return ranked.withColumn(column, (F.col("_own") + F.col("_offset")).cast("int")).drop("_key", "_at", "_range", "_own", "_offset")


def first_within(df: DataFrame, key: str, *order, limit: int) -> DataFrame:
    """The first ``limit`` rows of each key by ``order`` with ``position`` and ``total``, the number of all rows of the key.

    Spark keeps at most ``limit`` rows of a key in each partition before the shuffle, and counts are summed in part, so a hub's rows never meet.
    """
    top = df.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("position") <= limit)
    totals = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("total"))
    return top.join(totals, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
