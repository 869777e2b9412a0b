"""Evaluation: precision, recall, F1, regression and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precision(expected: Column, actual: Column, matched: Column) -> Column:
    """1 where nothing is found and nothing expected, 0 where nothing is found but something expected."""
    return F.when(actual > 0, matched / F.nullif(actual, F.lit(0))).when(expected == 0, 1.0).otherwise(0.0)


def recall(expected: Column, actual: Column, matched: Column) -> Column:
    return F.when(expected > 0, matched / F.nullif(expected, F.lit(0))).otherwise(1.0)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)


def scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to expected, actual and matched."""
    e, a, m = F.col("expected"), F.col("actual"), F.col("matched")
    return counts.withColumn("precision", precision(e, a, m)).withColumn("recall", recall(e, a, m)).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def set_counts(expected: DataFrame, actual: DataFrame, by: list[str]) -> DataFrame:
    """expected, actual and matched rows of two sets for each ``by``; the other columns are the members."""
    a, b = expected.distinct().withColumn("_e", F.lit(1)), actual.distinct().withColumn("_a", F.lit(1))
    both = a.join(b, list(expected.columns), "full_outer")
    return both.groupBy(*by).agg(F.count("_e").alias("expected"), F.count("_a").alias("actual"), F.count_if(F.col("_e").isNotNull() & F.col("_a").isNotNull()).alias("matched"))


def selection_counts(expected: DataFrame, selected: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """``set_counts`` of what was selected among the candidates; what was selected without having been one doesn't count."""
    return set_counts(expected, selected.select(expected.columns).intersect(candidates.select(expected.columns)), by)


def macro(scored: DataFrame) -> DataFrame:
    return scored.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])


def end_to_end(scored: DataFrame) -> DataFrame:
    """Adds passed: within budget, deterministic and nothing missed. Needs units, budget, first_digest, second_digest."""
    rows = scored.withColumn("within_budget", F.col("units") <= F.col("budget")).withColumn("deterministic", F.col("first_digest") == F.col("second_digest"))
    return rows.withColumn("passed", F.col("within_budget") & F.col("deterministic") & (F.col("recall") == 1.0))


def regression(baseline: DataFrame, current: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(case, before, after, delta, regressed) of cases in both; duplicated cases are refused when run."""
    once = lambda df, c: df.groupBy("case").agg(F.when(F.count("*") > 1, F.raise_error(F.lit("duplicate evaluation case"))).otherwise(F.max("f1")).cast("double").alias(c))
    rows = once(baseline, "before").join(once(current, "after"), "case")
    return rows.withColumn("delta", F.col("after") - F.col("before")).withColumn("regressed", F.col("delta") < -tolerance)


def coverage(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(case, gap): cases that are missing or unexpected."""
    missing = expected.select("case").subtract(actual.select("case")).withColumn("gap", F.lit("missing"))
    return missing.unionByName(actual.select("case").subtract(expected.select("case")).withColumn("gap", F.lit("unexpected")))


def evaluation_set(spark, root: str, repositories: list[str]) -> DataFrame:
    """The default cases: two tasks for each repository below ``root``."""
    rows = [(f"{r}:{t}", f"{root.rstrip('/')}/{r}", t) for r in repositories for t in ("structure", "retrieval")]
    return spark.createDataFrame(rows, "case string, path string, task string")
