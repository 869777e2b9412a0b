"""Projections, filters and point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import EXCERPT_LINES, REPORT_LIMIT, Graph
from ..session import checkpoint, few
from .order import first_within, positions, positions_within


def files_by_path(files: DataFrame, path: str, root: str | None = None) -> DataFrame:
    return files.where(F.col("path") == paths.normalise(F.lit(path), root))


def symbols_by(symbols: DataFrame, *, name: str | None = None, qualified_name: str | None = None, file_id: str | None = None) -> DataFrame:
    for column, value in (("name", name), ("qualified_name", qualified_name), ("file_id", file_id)):
        if value is not None:
            symbols = symbols.where(F.col(column) == value)
    return symbols


def _typed(edges: DataFrame, types) -> DataFrame:
    return edges if types is None else edges.where(F.col("relationship_type").isin(*types))


def edges_of(edges: DataFrame, entities: DataFrame, direction: str = "both", types=None) -> DataFrame:
    """Edges at the entities (entity_id): entity_id, direction, other_id and the edge; a self-loop counts both ways."""
    edges, parts = _typed(edges, types), []
    if direction in ("both", "outgoing"):
        parts.append(edges.join(entities, F.col("source_id") == F.col("entity_id")).select("entity_id", F.lit("outgoing").alias("direction"), F.col("target_id").alias("other_id"), *edges.columns))
    if direction in ("both", "incoming"):
        parts.append(edges.join(entities, F.col("target_id") == F.col("entity_id")).select("entity_id", F.lit("incoming").alias("direction"), F.col("source_id").alias("other_id"), *edges.columns))
    if not parts:
        raise ValueError(f"unknown direction {direction}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def neighbours(edges: DataFrame, entities: DataFrame, direction: str = "both", types=None) -> DataFrame:
    """(entity_id, other_id): a set for both directions, one row for each edge for one."""
    found = edges_of(edges, entities, direction, types).select("entity_id", "other_id")
    return found.distinct() if direction == "both" else found


def file_dependencies(graph: Graph, file_id: str, direction: str = "outgoing") -> DataFrame:
    """Files that the file imports (outgoing) or that import it (incoming)."""
    own, other = ("source_id", "target_id") if direction == "outgoing" else ("target_id", "source_id")
    ids = graph.edges.where((F.col("relationship_type") == "imports") & (F.col(own) == file_id)).select(F.col(other).alias("id"))
    return graph.files.join(ids, "id", "left_semi")


def entities(graph: Graph, ids: DataFrame) -> DataFrame:
    """Vertices of an id set with their order: files, directories, symbols."""
    rank = F.when(F.col("kind") == "file", 0).when(F.col("kind") == "directory", 1).otherwise(2)
    return graph.vertices().join(ids, "id", "left_semi").withColumn("kind_rank", rank)


def children(graph: Graph, directory_id: str) -> DataFrame:
    """Directories and files directly in a directory: kind, id, path."""
    dirs = graph.directories.where(F.col("parent_id") == directory_id).select(F.lit("directory").alias("kind"), "id", "path")
    return dirs.unionByName(graph.files.where(F.col("directory_id") == directory_id).select(F.lit("file").alias("kind"), "id", "path"))


def summary(graph: Graph) -> DataFrame:
    """(table, rows) for each table of the snapshot."""
    named = {"directories": graph.directories, "files": graph.files, "symbols": graph.symbols, "relationships": graph.edges, "imports": graph.imports, "errors": graph.errors}
    out = None
    for name, df in named.items():
        if df is not None:
            one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
            out = one if out is None else out.unionByName(one)
    return out


def _rung(targets: DataFrame, hits: DataFrame, on: Column, rank: int) -> DataFrame:
    return targets.join(hits, on).select("target", F.lit(rank).alias("rung"), "id", "kind", F.coalesce("path", F.lit("")).alias("path"), "name", F.coalesce("is_import", F.lit(False)).alias("is_import"))


def resolve_targets(graph: Graph, targets: DataFrame, limit: int = REPORT_LIMIT) -> DataFrame:
    """What each ``target`` string names: target, status, candidates (all of them), id, candidate_ids (the first ``limit``).

    Exact file paths come first. A dotted target is a qualified or module-qualified symbol, then a
    module, then a bare name; any other a bare name, then a module. Definitions beat imports and
    imports alone are not found. One candidate is resolved, several are ambiguous.
    """
    # Targets and symbols are read by every rung, however many joins they come from.
    targets = checkpoint(targets.select("target").distinct())
    files = graph.files.select("id", F.lit("file").alias("kind"), "path", "name", F.lit(False).alias("is_import"), paths.query_module(F.col("path")).alias("module"), paths.build_module(F.col("path")).alias("raw_module"))
    symbols = graph.symbols.join(files.select(F.col("id").alias("file_id"), "path", "module"), "file_id", "left").select("id", F.lit("symbol").alias("kind"), "path", "name", "qualified_name", (F.col("kind") == "import").alias("is_import"), F.concat_ws(".", "module", "qualified_name").alias("in_module"))
    symbols = checkpoint(symbols)
    dotted, plain = targets.where(F.contains("target", F.lit("."))), targets.where(~F.contains("target", F.lit(".")))
    modules = files.select("id", "kind", "path", "name", "is_import", F.explode(F.array_distinct(F.array("module", "raw_module"))).alias("m"))
    parts = [
        _rung(targets.withColumn("norm", paths.normalise(F.col("target"))), files, F.col("norm") == F.col("path"), 0),
        _rung(dotted, symbols, F.col("target") == F.col("qualified_name"), 1),
        _rung(dotted, symbols, F.col("target") == F.col("in_module"), 1),
        _rung(dotted, modules, F.col("target") == F.col("m"), 2),
        _rung(dotted, symbols, F.col("target") == F.col("name"), 3),
        _rung(plain, symbols, F.col("target") == F.col("name"), 1),
        _rung(plain, modules, F.col("target") == F.col("m"), 2),
    ]
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    hits = hits.where(~F.col("is_import")).dropDuplicates(["target", "rung", "id"])
    best = hits.groupBy("target").agg(F.min("rung").alias("rung"))
    listed = first_within(hits.join(best, ["target", "rung"]), "target", "path", "name", "id", limit=limit)
    chosen = listed.groupBy("target").agg(F.max("total").alias("candidates"), F.sort_array(F.collect_list(F.struct("path", "name", "id"))).alias("c"))
    out = targets.join(chosen, "target", "left")
    status = F.when(F.col("candidates").isNull(), "not_found").when(F.col("candidates") == 1, "resolved").otherwise("ambiguous")
    return out.select("target", status.alias("status"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.when(F.col("candidates") == 1, F.col("c")[0]["id"]).alias("id"), F.transform("c", lambda x: x["id"]).alias("candidate_ids"))


def changeset_paths(files: DataFrame, asked: DataFrame, root: str | None = None) -> DataFrame:
    """``asked`` (path) with status and id: indexed, unindexed, outside_root or invalid.

    Absolute paths lie in the tree where they begin with ``root``; relative ones that climb out of it don't. Null and blank
    paths are invalid. ``files``: id, path.
    """
    raw = F.trim("path")
    rows = asked.withColumn("_norm", paths.normalise(raw, root))
    climbs = F.col("_norm").isNull() | F.col("_norm").rlike(r"^\.\.(/|$)")
    met = rows.join(files.select(F.col("path").alias("_norm"), "id"), "_norm", "left")
    status = F.when(raw.isNull() | (raw == ""), "invalid").when(climbs, "outside_root").when(F.col("id").isNull(), "unindexed").otherwise("indexed")
    return met.withColumn("status", status).select(*asked.columns, "status", "id")


def changeset_targets(graph: Graph, asked: DataFrame, root: str | None = None, on_disk: DataFrame | None = None, limit: int = REPORT_LIMIT) -> DataFrame:
    """``asked`` (path) with status, id and candidates: what each path or name of a change set means.

    invalid (blank), outside_root (absolute and not below ``root``, or climbing), resolved (a file of that path, or what ``resolve_targets`` finds), ambiguous,
    unindexed (not in the snapshot but in ``on_disk``, path), not_found. Repeated rows repeat.
    """
    raw = F.trim("path")
    norm = paths.normalise(raw, root)
    climbs = norm.isNull() | F.array_contains(F.split(norm, "/"), "..") | norm.rlike("^[A-Za-z]:")
    bad = F.when(raw.isNull() | (raw == ""), "invalid").when(climbs, "outside_root")
    rows = asked.select("path").distinct().withColumns({"_norm": norm, "_bad": bad, "_raw": raw})
    known = graph.files.groupBy(paths.normalise(F.col("path")).alias("_norm")).agg(F.count("*").alias("_n"), F.min("id").alias("_file"))
    rows = checkpoint(rows.join(known, "_norm", "left"))
    open_ = rows.where("_bad is null and _n is null")
    named = resolve_targets(graph, open_.select(F.col("_raw").alias("target")), limit).select(F.col("target").alias("_raw"), F.col("status").alias("_status"), F.col("id").alias("_named"), F.col("candidates").alias("_candidates"))
    rows = rows.join(named, "_raw", "left")
    seen = asked.sparkSession.createDataFrame([], "path string") if on_disk is None else on_disk.select("path")
    rows = rows.join(seen.distinct().select(F.col("path").alias("_norm"), F.lit(True).alias("_there")), "_norm", "left")
    status = F.coalesce("_bad", F.when(F.col("_n") == 1, "resolved").when(F.col("_n") > 1, "ambiguous"), F.when(F.col("_status") != "not_found", F.col("_status")), F.when(F.col("_there"), "unindexed"), F.lit("not_found"))
    told = rows.select(F.col("path").alias("_path"), status.alias("status"), F.when(F.col("_bad").isNull(), F.when(F.col("_n") == 1, F.col("_file")).otherwise(F.col("_named"))).alias("id"), F.when(F.col("_bad").isNull(), F.coalesce("_n", "_candidates", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("candidates"))
    return asked.join(told, asked["path"].eqNullSafe(told["_path"]), "left").drop("_path")


def locate_symbols(graph: Graph, name: str, *, file_path: str | None = None, kind: str | None = None, qualified_name: str | None = None) -> DataFrame:
    """Symbols that ``name`` may mean, best rung only; imports stay only where nothing else is found."""
    owners = graph.files.select(F.col("id").alias("file_id"), "path", F.col("name").alias("file_name"), paths.query_module(F.col("path")).alias("module"))
    rows = graph.symbols.join(owners, "file_id")
    if file_path is not None:
        rows = rows.where((F.col("path") == paths.normalise(F.lit(file_path))) | (F.col("file_name") == file_path))
    if kind is not None:
        rows = rows.where(F.lower("kind") == kind.lower())
    if qualified_name is not None:
        rows = rows.where(F.col("qualified_name") == qualified_name)
    rung = F.when((F.col("qualified_name") == name) | (F.concat_ws(".", "module", "qualified_name") == name), 0).when(F.col("name") == name, 1)
    rows = rows.withColumn("rung", rung.cast("int") + F.when(F.col("kind") == "import", 10).otherwise(0)).where(F.col("rung").isNotNull())
    best = rows.agg(F.min("rung").alias("best"))
    return rows.join(F.broadcast(best), F.col("rung") == F.col("best")).drop("best", "rung", "module", "file_name")


def memory_symbols(graph: Graph, name: str, *, file_path: str | None = None, kind: str | None = None) -> DataFrame:
    """Symbols that ``name`` stands for, with path and position by path, line and name.

    A dotted name is looked up as a qualified name; where that finds nothing or imports alone, as module and qualified name; where
    neither finds any, as a name. ``file_path`` (a path, or a bare file name) and ``kind`` come after that choice. Imports stay only where nothing else is left, or where they are asked for.
    """
    name = name.strip()
    owners = graph.files.select(F.col("id").alias("file_id"), "path", F.col("name").alias("file_name"), paths.query_module(F.col("path")).alias("module"))
    rows = graph.symbols.join(owners, "file_id", "left").withColumn("plain", F.col("name") == name)
    full = F.coalesce("qualified_name", "name")
    qualified = F.coalesce(F.col("qualified_name") == name, F.lit(False)) if "." in name else F.lit(False)
    in_module = qualified | F.coalesce((F.col("module") != "") & (F.concat_ws(".", "module", full) == name), F.lit(False)) if "." in name else F.lit(False)
    rows = rows.withColumns({"qualified": qualified, "in_module": in_module, "is_import": F.col("kind") == "import"}).where("plain or qualified or in_module")
    # One row each: what was found at all, then whether definitions are left.
    found = rows.agg(F.count_if(F.col("qualified") & ~F.col("is_import")).alias("defined"), F.count_if("qualified").alias("named"), F.count_if("in_module").alias("of_modules"))
    chosen = F.when(F.col("defined") > 0, F.col("qualified")).when(F.col("of_modules") > 0, F.col("in_module")).when(F.col("named") > 0, F.col("qualified")).otherwise(F.col("plain"))
    rows = rows.crossJoin(F.broadcast(found)).where(chosen)
    if file_path is not None:
        wanted = file_path.strip().replace("\\", "/").removeprefix("./")
        at = F.col("path") == wanted
        rows = rows.where(at if "/" in wanted else at | (F.col("file_name") == wanted))
    if kind is not None:
        rows = rows.where(F.lower("kind") == kind.strip().lower())
    if kind is None or kind.strip().lower() != "import":
        left = rows.agg(F.count_if(~F.col("is_import")).alias("definitions"))
        rows = rows.crossJoin(F.broadcast(left)).where(~F.col("is_import") | (F.col("definitions") == 0))
    rows = rows.select(*graph.symbols.columns, "path")
    return positions(rows, F.coalesce("path", F.lit("")), F.coalesce("start_line", F.lit(0)), "name", "id")


def line_of(metadata: Column) -> Column:
    return F.expr("try_cast(metadata['line'] AS int)") if metadata is None else F.try_element_at(metadata, F.lit("line")).try_cast("int")


def reference_listing(graph: Graph, symbol_ids: DataFrame) -> DataFrame:
    """References to symbols: symbol_id, path, line (null where it isn't a number), edge id, position by (path, line, id)."""
    hits = graph.edges.where("relationship_type = 'references'").join(symbol_ids, F.col("target_id") == F.col("symbol_id"))
    listed = hits.join(few(graph.files.select(F.col("id").alias("source_id"), "path"), graph.files.count()), "source_id").select("symbol_id", "path", line_of(F.col("metadata")).alias("line"), "id")
    return positions_within(listed, "symbol_id", "path", F.coalesce("line", F.lit(0)), "id")


def relationship_listing(graph: Graph, edges: DataFrame) -> DataFrame:
    """Edges with both ends rendered; ends without a vertex are of kind unknown."""
    ends = graph.vertices().select("id", "kind", "name", "path")
    side = lambda p: ends.select(*[F.col(c).alias(f"{p}_{c}") for c in ends.columns])
    out = edges.join(side("source"), "source_id", "left").join(side("target"), "target_id", "left")
    return out.withColumns({f"{p}_kind": F.coalesce(f"{p}_kind", F.lit("unknown")) for p in ("source", "target")})


def excerpts(rows: DataFrame, max_lines: int) -> DataFrame:
    """Adds excerpt, excerpt_end, truncated and status to rows of content, start_line, end_line."""
    lines = paths.split_lines(F.col("content"))
    stop = F.least(F.col("end_line"), F.col("start_line") + max_lines - 1)
    status = F.when(F.col("content").isNull(), "missing_file").when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), "invalid_range").when(F.size(lines) < F.col("end_line"), "stale_location").otherwise("available")
    ok = F.col("status") == "available"
    out = rows.withColumn("status", status).withColumn("excerpt_end", F.when(ok, stop))
    text = F.array_join(F.slice(lines, F.col("start_line"), F.col("excerpt_end") - F.col("start_line") + 1), "\n")
    return out.withColumn("excerpt", F.when(ok, text)).withColumn("truncated", ok & (F.col("excerpt_end") < F.col("end_line")))


def source_evidence(rows: DataFrame, max_lines: int = EXCERPT_LINES) -> DataFrame:
    """``rows`` (name, kind, path, start_line, end_line, content, read_state) with status, excerpt, excerpt_end, truncated and header.

    ``read_state`` is what ``tree.read_sources`` says of the file. Status, in this order: invalid_location (no start, or an end before it),
    missing_file (no path, or no such file), path_outside_root, invalid_path, invalid_file_type, unreadable_file, location_out_of_range (the file
    is shorter), stale_location (the excerpt doesn't begin with the definition), success. An end past the file's is cut.
    """
    if max_lines < 1:
        raise ValueError("max_lines must be positive")
    lines = paths.split_lines(F.col("content"))
    start, end = F.col("start_line"), F.coalesce("end_line", "start_line")
    failed = F.when(start.isNull() | (start < 1) | (end < start), "invalid_location").when(F.coalesce("path", F.lit("")) == "", "missing_file").when(F.col("read_state") != "read", F.col("read_state")).when(F.size(lines) < start, "location_out_of_range")
    rows = rows.withColumn("_failed", failed)
    good = F.col("_failed").isNull()
    last = F.least(end, F.size(lines))
    rows = rows.withColumns({"excerpt_end": F.when(good, F.least(last, start + max_lines - 1)), "truncated": good & (last - start + 1 > max_lines)})
    text = F.array_join(F.slice(lines, start, F.col("excerpt_end") - start + 1), "\n")
    rows = header_status(rows.withColumn("excerpt", F.when(good, text)))
    return rows.withColumn("status", F.coalesce("_failed", F.when(F.col("header") == "stale", "stale_location"), F.lit("success"))).drop("_failed")


def header_status(rows: DataFrame) -> DataFrame:
    """Whether ``excerpt`` starts with the definition of ``name`` by ``kind``: valid, stale or unsupported.

    Decorators, comments, blank lines and the rest of brackets opened before are passed over, within
    the first 15 lines.
    """
    head = F.array_join(F.slice(F.split(F.col("excerpt"), "\n"), 1, 15), "\n")
    bare = F.element_at(F.split("name", r"\."), -1)
    lead = r"(?s)^\s*(?:(?:@[^\n]*(?:\((?:[^()]|\([^()]*\))*\))?|#[^\n]*)?\s*\n\s*)*"
    quoted = F.concat(F.lit(r"\Q"), bare, F.lit(r"\E"))
    end = F.lit(r"(?:[\s(:\[].*|)$")
    kind = F.lower("kind")
    pattern = F.when(kind == "class", F.concat(F.lit(lead + r"class\s+"), quoted, end)).when(kind.isin("function", "method"), F.concat(F.lit(lead + r"(?:async\s+)?def\s+"), quoted, end))
    assigned = F.concat(F.lit(lead + r"(?:[A-Za-z_]\w*\s*(?::[^=\n]+)?=\s*)*"), quoted, F.lit(r"\s*(?::(?!:)|=(?!=)).*$"))
    pattern = F.when(kind.isin("variable", "constant"), assigned).otherwise(pattern)
    return rows.withColumn("header", F.when(pattern.isNull() | F.col("excerpt").isNull(), "unsupported").when(F.regexp_like(head, pattern), "valid").otherwise("stale"))
