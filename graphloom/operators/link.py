"""Linking: parsed imports, references and base classes become edges.

Each rung of a ladder is an aggregate of the candidates' side to names that are unique, then an
equi-join; common names never meet their references. An ambiguous rung doesn't end
a ladder, the next one is tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import Graph, edge_id


def _edges(rows: DataFrame, kind: str, confidence: Column, metadata: Column) -> DataFrame:
    return rows.select(edge_id(F.col("source_id"), F.col("target_id"), F.lit(kind)).alias("id"), "source_id", "target_id", F.lit(kind).alias("relationship_type"), confidence.cast("double").alias("confidence"), metadata.alias("metadata"))


def _parsed(**more: Column) -> Column:
    """Edge metadata: that the edge was parsed, and what is known besides; null values are left out."""
    pairs = [x for key, value in more.items() for x in (F.lit(key), value.cast("string"))]
    return F.map_filter(F.create_map(F.lit("source"), F.lit("ast"), *pairs), lambda _, v: v.isNotNull())


def _as_written() -> Column:
    return _parsed(name=F.col("name"), line=F.col("line"), qualified_name=F.col("qualified_name"))


def defines(symbols: DataFrame) -> DataFrame:
    return _edges(symbols.select(F.col("file_id").alias("source_id"), F.col("id").alias("target_id")).distinct(), "defines", F.lit(1.0), _parsed())


def contains(symbols: DataFrame) -> DataFrame:
    parents = symbols.select(F.col("id").alias("parent_symbol_id"))
    rows = symbols.select("parent_symbol_id", F.col("id").alias("target_id")).join(parents, "parent_symbol_id", "left_semi")
    return _edges(rows.select(F.col("parent_symbol_id").alias("source_id"), "target_id").distinct(), "contains", F.lit(1.0), _parsed())


def module_index(files: DataFrame) -> DataFrame:
    """(module, target_id): of files with one module name the last by path."""
    rows = files.where(F.col("path").rlike(r"\.pyi?$")).select(paths.build_module(F.col("path")).alias("module"), "id", "path")
    return rows.where("module <> ''").groupBy("module").agg(F.max_by("id", "path").alias("target_id"))


def import_targets(files: DataFrame, imports: DataFrame) -> DataFrame:
    """``imports`` with m1 and m2, the modules that each may mean, in order of preference.

    Absolute imports name a module, or a module's submodule; relative ones leave the last part of the
    file's own name, climb, and go on from there. Climbing past the top gives nothing.
    """
    own = files.select(F.col("id").alias("file_id"), F.split(paths.build_module(F.col("path")), r"\.").alias("own"))
    stem = F.regexp_replace("module_name", r"^\.+", "")
    keep = F.size("own") - F.greatest(F.col("level"), F.lit(0))
    base = F.array_join(F.when(keep > 0, F.slice("own", 1, keep)).otherwise(F.array().cast("array<string>")), ".")
    dotted = lambda *c: F.array_join(F.filter(F.array(*c), lambda x: x.isNotNull() & (x != "")), ".")
    whole = F.when(F.col("level") > 0, F.when(keep >= 0, dotted(base, stem))).otherwise(stem)
    rows = imports.join(own, "file_id", "left").withColumn("m1", whole).drop("own")
    return rows.withColumn("m2", F.when(F.col("imported_name").isNotNull() & (F.col("m1") != ""), dotted("m1", "imported_name")))


def resolve_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """``imports`` with target_id, null where nothing matches."""
    rows, index = import_targets(files, imports), module_index(files)
    for k in (1, 2):
        rows = rows.join(index.select(F.col("module").alias(f"m{k}"), F.col("target_id").alias(f"t{k}")), f"m{k}", "left")
    return rows.select(*imports.columns, F.coalesce("t1", "t2").alias("target_id"))


def import_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """One edge for each pair of files, from its first import."""
    found = resolve_imports(files, imports).where("target_id is not null").select(F.col("file_id").alias("source_id"), "target_id", "module_name", "ordinal")
    first = found.groupBy("source_id", "target_id").agg(F.min_by("module_name", "ordinal").alias("module_name"))
    return _edges(first, "imports", F.lit(1.0), _parsed(module=F.col("module_name")))


def named(symbols: DataFrame) -> DataFrame:
    """(scope, by, key, id): every name and qualified name of symbols that aren't imports, and again those of classes."""
    of = lambda scope, by: F.struct(F.lit(scope).alias("scope"), F.lit(by).alias("by"), F.col(by).alias("key"))
    every = [of("symbol", "name"), of("symbol", "qualified_name")]
    classes = [of("class", "name"), of("class", "qualified_name")]
    rows = symbols.where("kind <> 'import'").select("id", F.explode(F.when(F.col("kind") == "class", F.array(*every, *classes)).otherwise(F.array(*every))).alias("k"))
    return rows.select("k.scope", "k.by", "k.key", "id").where("key is not null")


def count_names(symbols: DataFrame) -> DataFrame:
    """(scope, by, key, n, id): how many symbols a name names, and which where it is one; a common name is one row."""
    n = F.count_distinct("id")
    return named(symbols).groupBy("scope", "by", "key").agg(n.alias("n"), F.when(n == 1, F.min("id")).alias("id"))


def _counted(names: DataFrame, scope: str, by: str, to: str) -> DataFrame:
    return names.where((F.col("scope") == scope) & (F.col("by") == by)).select(F.col("key").alias(to), "n", "id")


def _unique(names: DataFrame, scope: str, by: str, out: str) -> DataFrame:
    """(by, out): the symbol that a name names, where it names one only."""
    return _counted(names, scope, by, by).where("n = 1").select(by, F.col("id").alias(out))


def bindings(imports: DataFrame) -> DataFrame:
    """(file_id, name, bare, full, binding): what a name that an import binds may be called where it is defined."""
    stem = F.regexp_replace("module_name", r"^\.+", "")
    last = F.element_at(F.split("module_name", r"\."), -1)
    return imports.select(
        "file_id",
        F.coalesce("alias", "imported_name", last).alias("name"),
        F.coalesce("imported_name", last).alias("bare"),
        F.concat_ws(".", F.nullif(stem, F.lit("")), "imported_name").alias("full"),
        F.col("ordinal").alias("binding"),
    )


def _bound(refs: DataFrame, imports: DataFrame, names: DataFrame, scope: str) -> DataFrame:
    """(file_id, ordinal, binding, n, id): what a reference may mean through the imports of its file: the number of symbols and one of them."""
    met = refs.select("file_id", "name", "ordinal").join(bindings(imports), ["file_id", "name"])
    by = lambda key, to: met.join(_counted(names, scope, key, to), to).select("file_id", "ordinal", "binding", "n", "id")
    return by("qualified_name", "full").unionByName(by("name", "bare"))


def _only(bound: DataFrame, keys: list[str], out: str) -> DataFrame:
    """(keys, out): the symbol that all rows of the key name, where it is one."""
    return bound.groupBy(*keys).agg(F.max("n").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias(out)).where("n = 1 and ids = 1").drop("n", "ids")


def reference_edges(symbols: DataFrame, references: DataFrame, imports: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """File to symbol: unique by qualified name 1.0, through an import 0.9, in the file 0.8, everywhere 0.7; first line only.

    ``names`` are the counts over all symbols (by default of ``symbols``); ``symbols`` itself needs no more than those of the referring files.
    """
    names = count_names(symbols) if names is None else names
    local = symbols.where("kind <> 'import'").groupBy("file_id", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("s")).where("n = 1").drop("n")
    # References without a qualified name would all meet in one task; they get keys that no name has.
    full = F.coalesce("qualified_name", F.concat(F.lit("\0"), F.pmod(F.xxhash64("file_id", "ordinal"), F.lit(4096)).cast("string")))
    found = references.withColumn("_full", full).join(_unique(names, "symbol", "qualified_name", "q").withColumnRenamed("qualified_name", "_full"), "_full", "left").drop("_full")
    bound = _only(_bound(references, imports, names, "symbol"), ["file_id", "ordinal"], "b")
    found = found.join(bound, ["file_id", "ordinal"], "left").join(local, ["file_id", "name"], "left").join(_unique(names, "symbol", "name", "g"), "name", "left")
    confidence = F.when(F.col("q").isNotNull(), 1.0).when(F.col("b").isNotNull(), 0.9).when(F.col("s").isNotNull(), 0.8).otherwise(0.7)
    rows = found.select(F.col("file_id").alias("source_id"), F.coalesce("q", "b", "s", "g").alias("target_id"), confidence.alias("c"), "name", "qualified_name", "line", F.coalesce("col", F.lit(-1)).alias("col"), "ordinal").where("target_id is not null")
    return _first(rows, F.struct("line", "col", "ordinal"), "references")


def inheritance_edges(symbols: DataFrame, bases: DataFrame, imports: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Class to class: unique by qualified name 1.0, through the first import that is unique 0.9, by name 0.8; never to itself."""
    names = count_names(symbols) if names is None else names
    found = bases.join(_unique(names, "class", "qualified_name", "q"), "qualified_name", "left")
    each = _only(_bound(bases, imports, names, "class"), ["file_id", "ordinal", "binding"], "id")
    bound = each.groupBy("file_id", "ordinal").agg(F.min_by("id", "binding").alias("b"))
    found = found.join(bound, ["file_id", "ordinal"], "left").join(_unique(names, "class", "name", "g"), "name", "left")
    confidence = F.when(F.col("q").isNotNull(), 1.0).when(F.col("b").isNotNull(), 0.9).otherwise(0.8)
    rows = found.select(F.col("class_symbol_id").alias("source_id"), F.coalesce("q", "b", "g").alias("target_id"), confidence.alias("c"), "name", "qualified_name", "line", "ordinal").where("target_id is not null and source_id <> target_id")
    return _first(rows, F.col("ordinal"), "inherits")


def _first(rows: DataFrame, order: Column, kind: str) -> DataFrame:
    """One edge for each pair of ends, as its first row in ``order`` has it."""
    first = rows.groupBy("source_id", "target_id").agg(F.min_by(F.struct("c", "name", "line", "qualified_name"), order).alias("f")).select("source_id", "target_id", "f.*")
    return _edges(first, kind, F.col("c"), _as_written())


def build_edges(graph: Graph, names: DataFrame | None = None) -> DataFrame:
    """All edges that the parsed tables give."""
    names = count_names(graph.symbols) if names is None else names
    out = defines(graph.symbols)
    for part in (contains(graph.symbols), import_edges(graph.files, graph.imports), reference_edges(graph.symbols, graph.references, graph.imports, names), inheritance_edges(graph.symbols, graph.inheritance, graph.imports, names)):
        out = out.unionByName(part)
    return out
