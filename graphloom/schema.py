"""Schemas of the property graph, its fixed domains and its ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECTORIES = "id string, path string, name string, parent_id string, depth int, directory_type string"
FILES = "id string, directory_id string, path string, name string, extension string, file_type string, size bigint, is_generated boolean, is_ignored boolean"
SYMBOLS = "id string, file_id string, name string, kind string, qualified_name string, start_line int, end_line int, parent_symbol_id string, signature string"
EDGES = "id string, source_id string, target_id string, relationship_type string, confidence double, metadata map<string,string>"
IMPORTS = "file_id string, module_name string, imported_name string, alias string, level int, ordinal bigint"
REFERENCES = "file_id string, name string, line int, col int, qualified_name string, kind string, ordinal bigint"
INHERITANCE = "file_id string, class_symbol_id string, name string, line int, col int, qualified_name string, ordinal bigint"
ERRORS = "message string, ordinal bigint"
FINGERPRINTS = "path string, size bigint, modified_at_ns bigint, content_hash string"

# Domains.
RELATIONSHIP_TYPES = ("defines", "imports", "references", "calls", "inherits", "contains", "depends_on")
#: Edges along which a change spreads (containment doesn't).
IMPACT_TYPES = ("imports", "references", "calls", "inherits", "depends_on")
CONTAINMENT_TYPES = ("defines", "contains")
USAGE_TYPES = ("references", "calls", "inherits", "depends_on")
COMPLETE = ("analyzed", "completed")

IMPACT_DEPTH, IMPACT_LIMIT = 3, 50
PATH_DEPTH, PATH_EXPANSIONS = 10, 1000
REPORT_LIMIT = 50
CONTEXT_UNITS = 20
EXCERPT_LINES = 50


@dataclass
class Graph:
    """The tables of one snapshot."""

    directories: DataFrame
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    imports: DataFrame | None = None
    references: DataFrame | None = None
    inheritance: DataFrame | None = None
    errors: DataFrame | None = None
    status: str = "analyzed"
    #: What linking keeps for the next refresh: how many symbols a name names, and the files whose links hang on a name.
    names: DataFrame | None = None
    referrers: DataFrame | None = None

    def vertices(self) -> DataFrame:
        """id, kind, name, path, qualified_name, file_id of files, symbols and directories."""
        null = F.lit(None).cast("string")
        files = self.files.select("id", F.lit("file").alias("kind"), "name", "path", null.alias("qualified_name"), F.col("id").alias("file_id"))
        dirs = self.directories.select("id", F.lit("directory").alias("kind"), "name", "path", null.alias("qualified_name"), null.alias("file_id"))
        owners = self.files.select(F.col("id").alias("file_id"), "path")
        symbols = self.symbols.join(owners, "file_id", "left").select("id", F.lit("symbol").alias("kind"), "name", "path", "qualified_name", "file_id")
        return files.unionByName(symbols).unionByName(dirs)


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def directory_id(path: Column) -> Column:
    return F.concat(F.lit("dir:"), path)


def edge_id(source: Column, target: Column, kind: Column, ordinal: Column | None = None) -> Column:
    """Stable across runs; parallel edges of one type differ by ordinal."""
    parts = [source, target, kind] + ([ordinal.cast("string")] if ordinal is not None else [])
    return F.md5(F.concat_ws("|", *parts))


def metadata_key(metadata: Column) -> Column:
    """Maps can't be ordered; their sorted entries can."""
    return F.array_sort(F.map_entries(metadata))


def violations(graph: Graph) -> DataFrame:
    """(table, id, rule) of every row that breaks an invariant of the model."""
    def bad(table: str, df: DataFrame, key: str, *rules: tuple[str, Column]) -> list[DataFrame]:
        return [df.where(when).select(F.lit(table).alias("table"), F.col(key).alias("id"), F.lit(rule).alias("rule")) for rule, when in rules]

    parts = [
        *bad("edges", graph.edges, "id", ("confidence_range", ~F.col("confidence").between(0, 1) | F.col("confidence").isNull()), ("relationship_type", ~F.col("relationship_type").isin(*RELATIONSHIP_TYPES))),
        *bad("symbols", graph.symbols, "id", ("empty_name", F.trim("name") == ""), ("line_range", (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")))),
        *bad("directories", graph.directories, "id", ("negative_depth", F.col("depth") < 0)),
        *bad("files", graph.files, "id", ("negative_size", F.col("size") < 0), ("empty_name", F.trim("name") == "")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
