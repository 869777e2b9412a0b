"""Incremental refresh: a stream of file versions kept as a table of the latest, and fed to the graph."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import paths
from ..operators import changes, classify, relink
from ..schema import Graph
from ..session import checkpoint
from ..sources import parse, snapshot

#: path, content (null: deleted), at
VERSIONS = "path string, content string, at timestamp"


def latest(versions: DataFrame) -> DataFrame:
    """The last version of each path; of equal times the greater hash, so that order doesn't matter."""
    return versions.groupBy("path").agg(F.max_by(F.struct("content", "at"), F.struct("at", F.coalesce(F.sha2("content", 256), F.lit("")))).alias("v")).select("path", "v.*")


def apply_versions(graph: Graph, versions: DataFrame, registry: parse.Registry | None = None, relinked: Observation | None = None) -> Graph:
    """``graph`` after the changed files in ``versions``: theirs are parsed, the rest is kept, and what their names concern is linked again.

    A graph without its tables of names gets them first; snapshots keep them for the next batch.
    """
    graph = graph if graph.names is not None and graph.referrers is not None else relink.indexed(graph)
    last = checkpoint(latest(versions))
    there = last.where("content is not null")
    base = changes.without_paths(graph, last)
    files = there.select(F.concat(F.lit("file:"), "path").alias("id"), "path", "content")
    parts = parse.tables(checkpoint(parse.parse_files(files, registry)))
    path, name = F.col("path"), paths.name_of(F.col("path"))
    fresh = files.select("id", F.concat(F.lit("dir:"), paths.parent_of(path)).alias("directory_id"), "path", name.alias("name"), paths.suffix_of(name).alias("extension"), classify.file_type(path).alias("file_type"), F.octet_length("content").cast("bigint").alias("size"), classify.is_generated(path).alias("is_generated"), F.lit(False).alias("is_ignored"))
    out = Graph(graph.directories, base.files.unionByName(fresh), base.symbols.unionByName(parts["symbols"]), graph.edges.where("false"), base.imports.unionByName(parts["imports"]), base.references.unionByName(parts["references"]), base.inheritance.unionByName(parts["inheritance"]), changes.without_errors(graph.errors, last).unionByName(parts["errors"]), graph.status)
    return relink.relink(graph, out, last, relinked)


def refresh_stream(versions: DataFrame, store: str, state: str, empty: Callable[[], Graph], registry: parse.Registry | None = None) -> StreamingQuery:
    """Runs ``apply_versions`` on each micro-batch against the current snapshot and publishes a new one.

    ``state`` is the stream's checkpoint folder. Each attempt at a batch writes a folder of its own, so a
    batch that failed half-way never reads what it overwrites; one whose snapshot was published before the
    failure is passed over when it comes again.
    """
    def batch(rows: DataFrame, number: int) -> None:
        spark, name = rows.sparkSession, f"batch-{number:012d}"
        published = (snapshot.manifest(spark, store) or {}).get("version", "")
        if not rows.isEmpty() and not published.startswith(name):
            snapshot.save(spark, apply_versions(snapshot.load(spark, store) or empty(), rows, registry), store, version=f"{name}-{uuid.uuid4().hex[:8]}")

    return versions.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
