"""Shared helpers: table paths, checkpoints and bounded Arrow slices."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step holds at most (one longer text is a step of its own).
SLICE_BYTES = 1 << 19
#: Rows of an Arrow batch, where the session leaves Spark's own figure.
BATCH_ROWS = 1000
ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage into the shared folder named by ``spark.checkpoint.dir``.

    The folder is set here only where the session has none and runs in this process alone (tests, local
    runs); on a cluster a folder of this machine would be lost with it, so that is an error.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``df`` written to the same shared folder as Parquet: half the size of a checkpoint, and only the columns that are asked for are read."""
    folder = f"{_shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def packed(df: DataFrame) -> DataFrame:
    """``stored`` by zstd: a third of a checkpoint for rows of ids and counts, less for texts."""
    return stored(df, "zstd")


def forget(df: DataFrame) -> None:
    """Deletes what ``stored`` or ``packed`` wrote, once nothing reads it any more."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._folder)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it learns of them by garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS, so that long texts and sets stay within a worker's memory."""
    if spark.conf.get(ROWS_SETTING) == "10000":
        spark.conf.set(ROWS_SETTING, str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``SLICE_BYTES`` of ``column``."""
    sizes = [0 if n is None else n for n in pa.compute.binary_length(batch.column(column)).to_pylist()]
    start = held = 0
    for row, size in enumerate(sizes):
        if row > start and held + size > SLICE_BYTES:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def by_slice(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """``mapInArrow`` over bounded slices; ``work`` maps one slice to one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
