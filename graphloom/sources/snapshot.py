"""Snapshots: versioned folders of Parquet with a manifest that makes a version the current one."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..operators.changes import ANALYZER_VERSION, SCHEMA_VERSION
from ..schema import Graph

TABLES = ("directories", "files", "symbols", "edges", "imports", "references", "inheritance", "errors")
#: Tables that only the next refresh reads.
INDEX = ("names", "referrers")


def _path(spark: SparkSession, text: str):
    return spark._jvm.org.apache.hadoop.fs.Path(text)


def _fs(spark: SparkSession, text: str):
    return _path(spark, text).getFileSystem(spark._jsc.hadoopConfiguration())


def save(spark: SparkSession, graph: Graph, store: str, fingerprints: DataFrame | None = None, version: str | None = None) -> str:
    """Writes a new version and then, as the commit point, its manifest. Readers see the old version until then."""
    version = version or str(time.time_ns())
    for name in TABLES + INDEX:
        df = getattr(graph, name)
        if df is not None:
            df.write.mode("overwrite").parquet(f"{store}/{version}/{name}")
    if fingerprints is not None:
        fingerprints.write.mode("overwrite").parquet(f"{store}/{version}/fingerprints")
    manifest = {"version": version, "schema_version": SCHEMA_VERSION, "analyzer_version": ANALYZER_VERSION, "status": graph.status, "tables": [n for n in TABLES + INDEX if getattr(graph, n) is not None] + (["fingerprints"] if fingerprints is not None else [])}
    fs = _fs(spark, store)
    out = fs.create(_path(spark, f"{store}/_next.json"), True)
    out.write(json.dumps(manifest).encode())
    out.close()
    current = _path(spark, f"{store}/_current.json")
    if fs.exists(current):
        fs.delete(current, False)
    if not fs.rename(_path(spark, f"{store}/_next.json"), current):
        raise RuntimeError("the manifest couldn't be put in place")
    return version


def manifest(spark: SparkSession, store: str) -> dict | None:
    """What the current version is, read by Spark so that any store will do; a manifest that was just being replaced counts."""
    fs = _fs(spark, store)
    for name in ("_current.json", "_next.json"):
        at = _path(spark, f"{store}/{name}")
        if fs.exists(at):
            stream = fs.open(at)
            try:
                return json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
    return None


def load(spark: SparkSession, store: str) -> Graph | None:
    found = manifest(spark, store)
    if found is None:
        return None
    read = {n: spark.read.parquet(f"{store}/{found['version']}/{n}") for n in found["tables"] if n in TABLES + INDEX}
    return Graph(**read, status=found["status"])


def load_fingerprints(spark: SparkSession, store: str) -> DataFrame | None:
    found = manifest(spark, store)
    return spark.read.parquet(f"{store}/{found['version']}/fingerprints") if found and "fingerprints" in found["tables"] else None


def invalidate(spark: SparkSession, store: str) -> bool:
    """Drops the pointer to the current version; the files stay for readers that hold it."""
    fs = _fs(spark, store)
    return any([fs.delete(_path(spark, f"{store}/{n}"), False) for n in ("_current.json", "_next.json")])


def _ordered(value: Column, kind: DataType) -> Column:
    """``value`` with the fields of all its structs in alphabetical order."""
    if isinstance(kind, StructType):
        fields = F.struct(*(_ordered(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
        return F.when(value.isNotNull(), fields)
    return F.transform(value, lambda x: _ordered(x, kind.elementType)) if isinstance(kind, ArrayType) else value


def package_json(units: DataFrame) -> DataFrame:
    """One JSON text a unit: keys in alphabetical order at every level, no blanks, nulls left out."""
    return units.select(F.to_json(F.struct(*(_ordered(F.col(f.name), f.dataType).alias(f.name) for f in sorted(units.schema.fields, key=lambda f: f.name)))).alias("json"))
