"""Evaluation baselines as JSON, checked strictly when read."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

VERSION = 1
FIELDS = {"case": str, "precision": float, "recall": float, "f1": float}


def save(scored: DataFrame, path: str) -> None:
    """case, precision, recall and f1, one entry a case, sorted. A baseline is a summary: one row for each case."""
    cases = [{k: r[k] for k in FIELDS} for r in scored.select(*FIELDS).orderBy("case").collect()]
    Path(path).write_text(json.dumps({"version": VERSION, "cases": cases}, sort_keys=True, separators=(",", ":")), encoding="utf-8")


def load(spark: SparkSession, path: str) -> DataFrame:
    try:
        held = json.loads(Path(path).read_text(encoding="utf-8"))
    except json.JSONDecodeError as error:
        raise ValueError(f"{path} is no JSON: {error}") from error
    if not isinstance(held, dict) or held.get("version") != VERSION or not isinstance(held.get("cases"), list):
        raise ValueError(f"{path} is no baseline of version {VERSION}")
    rows, seen = [], set()
    for case in held["cases"]:
        if not isinstance(case, dict) or set(case) != set(FIELDS) or not isinstance(case["case"], str) or not case["case"]:
            raise ValueError(f"{path} holds a malformed case")
        values = [case[k] for k in ("precision", "recall", "f1")]
        if any(isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= 1 for v in values):
            raise ValueError(f"{case['case']}: measures lie between 0 and 1")
        if case["case"] in seen:
            raise ValueError(f"{case['case']} occurs twice")
        seen.add(case["case"])
        rows.append((case["case"], *map(float, values)))
    return spark.createDataFrame(rows, "case string, precision double, recall double, f1 double")
