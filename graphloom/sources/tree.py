"""Source trees: directories, files, their content and fingerprints."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import classify, link
from ..schema import Graph, directory_id, file_id
from ..session import checkpoint
from . import parse

#: Rows of a listing that are handed on at once.
BATCH = 10_000
LISTING = "path string, is_directory boolean, size bigint, modified_at_ns bigint"


def listing(spark: SparkSession, root: str, ignored_files: tuple[str, ...] = ()) -> DataFrame:
    """path, is_directory, size, modified_at_ns of every directory and regular file below ``root``; ignored directories and links are passed over.

    The workers list the directories of a level, which gives the next one; ``root`` must lie where they see it. Names never
    come to the driver, and a directory of any size is handed on in batches. What vanishes or can't be read
    meanwhile has no rows. (Spark's own file listing leaves out names that begin with ``_`` or ``.``.)
    """
    skipped, unwanted = classify.IGNORED_DIRECTORIES, frozenset(ignored_files)

    def rows(top: str) -> Iterator[tuple]:
        try:
            entries = os.scandir(os.path.join(root, top))
        except OSError:
            return
        with entries:
            for entry in entries:
                path = entry.name if top == "." else f"{top}/{entry.name}"
                try:
                    if entry.is_symlink():
                        continue
                    if entry.is_dir():
                        if entry.name not in skipped:
                            yield path, True, 0, 0
                    elif entry.is_file() and entry.name not in unwanted:
                        info = entry.stat()
                        yield path, False, info.st_size, info.st_mtime_ns
                except OSError:
                    continue

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
        for batch in batches:
            for top in batch.column("path").to_pylist():
                found = rows(top)
                while part := list(itertools.islice(found, BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=["path", "is_directory", "size", "modified_at_ns"])

    out = level = spark.createDataFrame([(".", True, 0, 0)], LISTING)
    while True:
        level = checkpoint(level.where("is_directory").select("path").repartition("path").mapInArrow(run, LISTING))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def scan(spark: SparkSession, root: str, ignored_files: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(directories, files) of a tree, classified."""
    rows = listing(spark, root, ignored_files)
    path, name = F.col("path"), paths.name_of(F.col("path"))
    top = path == "."
    directories = rows.where("is_directory").select(
        directory_id(path).alias("id"), "path", F.when(top, F.lit(os.path.basename(os.path.abspath(root)))).otherwise(name).alias("name"), F.when(~top, directory_id(paths.parent_of(path))).alias("parent_id"),
        F.when(top, 0).otherwise(F.size(F.split(path, "/"))).alias("depth"), F.when(top, "source").otherwise(classify.directory_type(name)).alias("directory_type"),
    )
    files = rows.where("not is_directory").select(
        file_id(path).alias("id"), directory_id(paths.parent_of(path)).alias("directory_id"), "path", name.alias("name"), paths.suffix_of(name).alias("extension"), classify.file_type(path).alias("file_type"),
        "size", classify.is_generated(path).alias("is_generated"), F.lit(False).alias("is_ignored"),
    )
    return directories, files


def contents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """``files`` (id, path) with content, size, modified_at_ns; read by the workers, so ``root`` must lie where they see it."""
    def run(batches):
        for batch in batches:
            held: list[list] = [[], [], []]
            for path in batch.column("path").to_pylist():
                full = os.path.join(root, path)
                try:
                    with open(full, "rb") as file:
                        data, info = file.read(), os.fstat(file.fileno())
                    row = (data, info.st_size, info.st_mtime_ns)
                except OSError:
                    row = (None, None, None)
                for to, value in zip(held, row, strict=True):
                    to.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("path"), pa.array(held[0], pa.binary()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.int64())], names=["id", "path", "content", "size", "modified_at_ns"])

    return files.select("id", "path").mapInArrow(run, "id string, path string, content binary, size bigint, modified_at_ns bigint")


def read_sources(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (path) with content and read_state: read, missing_file, path_outside_root, invalid_path, invalid_file_type or unreadable_file.

    A path is outside where it is absolute or, once its links are followed, doesn't lie below ``root``. Bytes that aren't UTF-8 are replaced.
    """
    def read(path: str | None) -> tuple[str | None, str]:
        if not path:
            return None, "missing_file"
        if os.path.isabs(path):
            return None, "path_outside_root"
        try:
            base = os.path.realpath(root)
            full = os.path.realpath(os.path.join(base, path), strict=False)
            if os.path.commonpath([base, full]) != base:
                return None, "path_outside_root"
            if not os.path.exists(full):
                return None, "missing_file"
        except (OSError, ValueError):
            return None, "invalid_path"
        if not os.path.isfile(full):
            return None, "invalid_file_type"
        try:
            with open(full, encoding="utf-8", errors="replace", newline="") as file:
                return file.read(), "read"
        except OSError:
            return None, "unreadable_file"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                content, state = read(path)
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([content], pa.string()), pa.array([state])], names=["path", "content", "read_state"])

    return wanted.select("path").distinct().mapInArrow(run, "path string, content string, read_state string")


def fingerprints(read: DataFrame) -> DataFrame:
    """path, size, modified_at_ns and sha256 of read files."""
    return read.where("content is not null").select("path", "size", "modified_at_ns", F.sha2("content", 256).alias("content_hash"))


def current_fingerprints(spark: SparkSession, root: str, ignored_files: tuple[str, ...] = ()) -> DataFrame:
    """Fingerprints of the tree as it is now, added files among them."""
    return fingerprints(contents(spark, root, scan(spark, root, ignored_files)[1]))


def analyse(spark: SparkSession, root: str, registry: parse.Registry | None = None) -> Graph:
    """The whole graph of a tree: scanned, parsed and linked."""
    directories, files = scan(spark, root)
    parts = parse.tables(checkpoint(parse.parse_files(contents(spark, root, files), registry)))
    graph = Graph(directories, files, parts["symbols"], parts["symbols"].limit(0), parts["imports"], parts["references"], parts["inheritance"], parts["errors"])
    graph.edges = link.build_edges(graph)
    return graph
