"""Recorded runs: a start and a finish event each, appended to the store as they happen."""

from __future__ import annotations

import contextlib
import datetime
import logging
import logging.handlers
import os
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

EVENTS = "id string, command string, repository_path string, at timestamp, event string, outcome string, error_type string, error_message string"


def _append(spark: SparkSession, store: str, *row) -> None:
    spark.createDataFrame([row], EVENTS).coalesce(1).write.mode("append").parquet(f"{store}/runs")


@contextlib.contextmanager
def recorded_run(spark: SparkSession, store: str, command: str, repository_path: str) -> Iterator[str]:
    """Records the block as a run: success, failed with its error, or interrupted."""
    own = uuid.uuid4().hex
    now = lambda: datetime.datetime.now(datetime.UTC)
    _append(spark, store, own, command, repository_path, now(), "start", None, None, None)
    try:
        yield own
    except BaseException as error:
        outcome = "interrupted" if isinstance(error, KeyboardInterrupt) else "failed"
        _append(spark, store, own, None, None, now(), "finish", outcome, type(error).__name__, str(error))
        raise
    _append(spark, store, own, None, None, now(), "finish", "success", None, None)


def recorded(spark: SparkSession, store: str) -> DataFrame:
    """The events of all runs; none where nothing was recorded."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/runs")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], EVENTS)
    return spark.read.schema(EVENTS).parquet(f"{store}/runs")


#: The driver's log: a file of at most this many bytes, and so many older ones.
LOG_BYTES, LOG_FILES = 5 * 1024 * 1024, 3


@contextlib.contextmanager
def operational_log(folder: str | None, project: str) -> Iterator[dict]:
    """Logs start, and completion or failure of the block with its seconds, to a file in ``folder`` that is turned over when full.

    The block puts counts into the mapping it is given. A log that can't be written to doesn't disturb the block; without a folder nothing is logged.
    """
    log, counts = logging.Logger("graphloom.operations"), {}
    handler: logging.Handler = logging.NullHandler()
    if folder is not None:
        with contextlib.suppress(OSError):
            os.makedirs(folder, exist_ok=True)
            handler = logging.handlers.RotatingFileHandler(os.path.join(folder, "graphloom.log"), maxBytes=LOG_BYTES, backupCount=LOG_FILES, encoding="utf-8")
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s", datefmt="%Y-%m-%dT%H:%M:%S%z"))
    handler.handleError = lambda record: None
    log.addHandler(handler)
    began = time.monotonic()
    log.info("analysis_started project=%s", project)
    try:
        yield counts
    except BaseException as error:
        log.error("analysis_failed project=%s duration=%.3f error_type=%s error=%s", project, time.monotonic() - began, type(error).__name__, error)
        raise
    else:
        log.info("analysis_completed project=%s duration=%.3f %s", project, time.monotonic() - began, " ".join(f"{k}={v}" for k, v in counts.items()))
    finally:
        handler.close()
