"""Session defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "graphloom", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` override (dots as double underscores)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers once, for clusters whose Python doesn't have it.

    The archive goes to the shared folder of ``spark.checkpoint.dir``; where that is unset, as in local
    runs, to a folder of the driver, which serves it.
    """
    import io
    import os
    import tempfile
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_graphloom_shipped", False):
        return
    root, held = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(held, "w") as out:
        for top, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.join("graphloom", os.path.relpath(full, root)))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        archive = f"{shared.rstrip('/')}/{context.applicationId}/graphloom.zip"
        at = spark._jvm.org.apache.hadoop.fs.Path(archive)
        stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
        stream.write(held.getvalue())
        stream.close()
    else:
        archive = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), "graphloom.zip")
        with open(archive, "wb") as file:
            file.write(held.getvalue())
    context.addPyFile(archive)
    context._graphloom_shipped = True


def measured_broadcasts(spark: SparkSession, on: bool = True) -> None:
    """Joins broadcast a side by its measured size alone (``on``), or by the planner's estimate too, as Spark does by default.

    Estimates follow the size of files. Rows derived from a few columns of well compressed tables (sources, symbols, names) are many times as large, and a
    side that was to be under the threshold fills the driver. The threshold itself stays as the session has it.
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    estimated, measured = spark.conf.get(static), spark.conf.get(adaptive, None)
    if on and estimated != "-1":
        spark.conf.set(adaptive, measured or estimated)
        spark.conf.set(static, "-1")
        spark._graphloom_broadcasts = (estimated, measured)
    elif not on and getattr(spark, "_graphloom_broadcasts", None):
        estimated, measured = spark._graphloom_broadcasts
        spark.conf.set(static, estimated)
        spark.conf.set(adaptive, measured) if measured else spark.conf.unset(adaptive)
        spark._graphloom_broadcasts = None


#: Up to so many rows (some 40 MB as a hash table of ids and paths, measured at 60,000) a side that has been counted is broadcast.
FEW = 100_000


def few(df: DataFrame, n: int) -> DataFrame:
    """``df``, which has ``n`` rows, with a hint to broadcast it where these are few."""
    return F.broadcast(df) if n <= FEW else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of its own only in local runs without that setting."""
    import re
    import tempfile

    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the same shared folder and read again.

    For loops that join a table with itself: a checkpoint keeps the planner's estimate of its size, which such
    a loop multiplies each round until planning takes all the time; a table that is read has the size of its files.
    """
    import uuid

    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._graphloom_folder = folder
    return out


def forget(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing reads it any more."""
    folder = getattr(df, "_graphloom_folder", None)
    if folder is not None:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
