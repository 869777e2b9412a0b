"""Change detection, invalidation, merging, and the diff of two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COMPLETE, Graph, metadata_key

SCHEMA_VERSION, ANALYZER_VERSION = 2, "0.1.0"


def file_changes(cached: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) by content hash alone: unchanged, modified, added or deleted."""
    a = cached.select("path", F.col("content_hash").alias("before"))
    b = current.select("path", F.col("content_hash").alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(F.col("before") == F.col("after"), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change"))


def cache_reason(metadata: dict | None, cached: DataFrame | None, current: DataFrame | None) -> str:
    """Why a snapshot can't be used as it is, or ``fresh``."""
    if not metadata:
        return "missing_metadata"
    if metadata.get("schema_version") != SCHEMA_VERSION:
        return "schema_version_mismatch"
    if metadata.get("analyzer_version") != ANALYZER_VERSION:
        return "analyzer_version_mismatch"
    if cached is None or cached.isEmpty():
        return "missing_fingerprints"
    if current is None:
        return "missing_current_fingerprints"
    return "fresh" if file_changes(cached, current).where("change <> 'unchanged'").isEmpty() else "files_changed"


def invalidation(reason: str) -> str:
    """full, paths or none."""
    return {"fresh": "none", "files_changed": "paths"}.get(reason, "full")


def cache_reasons(metadata: DataFrame, cached: DataFrame, current: DataFrame) -> DataFrame:
    """(repository, reason, action) of many snapshots at once, by the ladder of ``cache_reason``.

    metadata: repository, schema_version, analyzer_version; cached and current: repository, path, content_hash.
    """
    prints = lambda df, name: df.select("repository", "path", F.col("content_hash").alias(name))
    both = prints(cached, "before").join(prints(current, "after"), ["repository", "path"], "full_outer")
    counts = both.groupBy("repository").agg(F.count("before").alias("had"), F.count("after").alias("has"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("changed"))
    rows = counts.join(metadata, "repository", "full_outer")
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    reason = (
        F.when(F.col("schema_version").isNull() & F.col("analyzer_version").isNull(), "missing_metadata")
        .when(~F.col("schema_version").eqNullSafe(SCHEMA_VERSION), "schema_version_mismatch")
        .when(~F.col("analyzer_version").eqNullSafe(ANALYZER_VERSION), "analyzer_version_mismatch")
        .when(none("had"), "missing_fingerprints")
        .when(none("has"), "missing_current_fingerprints")
        .when(F.col("changed") > 0, "files_changed")
        .otherwise("fresh")
    )
    action = F.when(F.col("reason") == "fresh", "none").when(F.col("reason") == "files_changed", "paths").otherwise("full")
    return rows.select("repository", reason.alias("reason")).withColumn("action", action)


def without_paths(graph: Graph, gone: DataFrame) -> Graph:
    """``graph`` less the files of ``gone`` (path), what they hold, and the edges at either."""
    files = graph.files.join(gone.select("path"), "path", "left_anti").select(graph.files.columns)
    lost = graph.files.join(gone.select("path"), "path", "left_semi").select("id")
    by_file = lost.select(F.col("id").alias("file_id"))
    symbols = graph.symbols.join(by_file, "file_id", "left_anti").select(graph.symbols.columns)
    ends = lost.unionByName(graph.symbols.join(by_file, "file_id", "left_semi").select("id"))
    edges = graph.edges.join(ends.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(ends.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(graph.edges.columns)
    keep = lambda df: None if df is None else df.join(by_file, "file_id", "left_anti").select(df.columns)
    return Graph(graph.directories, files, symbols, edges, keep(graph.imports), keep(graph.references), keep(graph.inheritance), graph.errors, graph.status)


def without_errors(errors: DataFrame, gone: DataFrame) -> DataFrame:
    """Errors less those that start with ``<path>:`` of a path in ``gone``."""
    at = F.regexp_extract("message", r"^([^:]+):", 1)
    return errors.join(gone.select(F.col("path").alias("_at")), at == F.col("_at"), "left_anti")


def merge(cached: Graph, parsed: Graph, changed: DataFrame) -> Graph:
    """Rows of unchanged files from ``cached`` and all of ``parsed``; edges are left to be linked anew."""
    kept = without_paths(cached, changed)
    union = lambda a, b: b if a is None else a if b is None else a.unionByName(b)
    errors = union(None if cached.errors is None else without_errors(cached.errors, changed), parsed.errors)
    return Graph(parsed.directories, parsed.files, union(kept.symbols, parsed.symbols), cached.edges.where("false"), union(kept.imports, parsed.imports), union(kept.references, parsed.references), union(kept.inheritance, parsed.inheritance), errors, parsed.status)


def validate_states(before: dict | None, after: dict | None) -> list[dict]:
    """Diagnostics on two states (repository, status, freshness): blockers, then warnings."""
    out = [{"severity": "blocker", "code": f"missing_{side}_state"} for side, state in (("before", before), ("after", after)) if not state]
    if out:
        return out
    if before["repository"] != after["repository"]:
        return [{"severity": "blocker", "code": "repository_mismatch"}]
    for side, state in (("before", before), ("after", after)):
        if state.get("status") not in COMPLETE:
            out.append({"severity": "warning", "code": f"incomplete_{side}_state"})
        if state.get("freshness", "current") != "current":
            out.append({"severity": "warning", "code": f"{state['freshness']}_{side}_state"})
    return out


def validate_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` of states to compare, with outcome (blocked, incomplete, partial, success), reason, is_complete and codes.

    Needs before_ and after_ repository, status, errors, freshness and historical. A state without status isn't supplied. A missing state and two known
    repositories that differ block. Unfinished analyses and ones with errors make it incomplete; freshness that is incomplete, indeterminate or, but for a
    historical state, stale makes it partial. Null freshness is unknown and no fault. ``codes`` (severity and code) has at most four entries.
    """
    missing = lambda side: F.col(f"{side}_status").isNull()
    known = [F.nullif(F.trim(F.col(f"{side}_repository").cast("string")), F.lit("")) for side in ("before", "after")]
    mismatch = F.coalesce(known[0] != known[1], F.lit(False))
    reason = F.when(missing("before"), "missing_before_state").when(missing("after"), "missing_after_state").when(mismatch, "repository_mismatch").otherwise("valid")
    code = lambda severity, name: F.struct(F.lit(severity).alias("severity"), (F.lit(name) if isinstance(name, str) else name).alias("code"))
    whole = {s: F.col(f"{s}_status").isin(*COMPLETE) & (F.coalesce(f"{s}_errors", F.lit(0)) == 0) for s in ("before", "after")}

    def doubt(side: str):
        state, old = F.col(f"{side}_freshness"), F.coalesce(f"{side}_historical", F.lit(False))
        return F.when(state == "incomplete", "INCOMPLETE_FRESHNESS").when(state == "indeterminate", "INDETERMINATE_FRESHNESS").when((state == "stale") & ~old, "STALE_STATE")

    warned = [F.when(~whole[s], code("warning", f"INCOMPLETE_{s.upper()}_STATE")) for s in whole] + [F.when(doubt(s).isNotNull(), code("warning", doubt(s))) for s in whole]
    rows = pairs.withColumn("reason", reason)
    blocked = F.col("reason") != "valid"
    codes = F.when(blocked, F.array(code("blocker", F.upper("reason")))).otherwise(F.filter(F.array(*warned), lambda w: w.isNotNull()))
    rows = rows.withColumn("codes", codes).withColumn("is_complete", ~blocked & whole["before"] & whole["after"])
    return rows.withColumn("outcome", F.when(blocked, "blocked").when(~F.col("is_complete"), "incomplete").when(F.size("codes") > 0, "partial").otherwise("success"))


def _moves(removed: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_before, n_after, old, new) of keys on both sides."""
    a = removed.groupBy(*keys).agg(F.count("*").alias("n_before"), F.min("item").alias("old"))
    b = added.groupBy(*keys).agg(F.count("*").alias("n_after"), F.min("item").alias("new"))
    return a.join(b, keys)


def diff_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, path, old_path) for files (path, size, content_hash).

    A shared path is modified by hash, or by size where a hash is missing. One removed and one added
    file with one hash are a move; more are ambiguous, and stay listed as added and removed too.
    """
    a = before.select("path", F.col("size").alias("sa"), F.col("content_hash").alias("ha"))
    b = after.select("path", F.col("size").alias("sb"), F.col("content_hash").alias("hb"))
    both = a.withColumn("ia", F.lit(True)).join(b.withColumn("ib", F.lit(True)), "path", "full_outer")
    differ = F.when(F.col("ha").isNotNull() & F.col("hb").isNotNull(), F.col("ha") != F.col("hb")).otherwise(F.col("sa") != F.col("sb"))
    kind = F.when(F.col("ia").isNull(), "added").when(F.col("ib").isNull(), "removed").when(differ, "modified")
    rows = both.withColumn("change", kind).where("change is not null")
    side = lambda c, h: rows.where(F.col("change") == c).where(F.col(h).isNotNull()).select(F.col(h).alias("hash"), F.col("path").alias("item"))
    met = _moves(side("removed", "ha"), side("added", "hb"), ["hash"])
    one = met.where("n_before = 1 and n_after = 1").select(F.lit("moved").alias("change"), F.col("new").alias("path"), F.col("old").alias("old_path"))
    many = met.where("n_before > 1 or n_after > 1").select("hash")
    unclear = side("removed", "ha").unionByName(side("added", "hb")).join(many, "hash", "left_semi").select(F.lit("ambiguous").alias("change"), F.col("item").alias("path"), F.lit(None).cast("string").alias("old_path"))
    moved = one.select(F.col("path").alias("item")).unionByName(one.select(F.col("old_path").alias("item")))
    plain = rows.join(moved, rows["path"] == moved["item"], "left_anti").select("change", "path", F.lit(None).cast("string").alias("old_path"))
    return plain.unionByName(one).unionByName(unclear)


def _symbol_rows(graph: Graph) -> DataFrame:
    return graph.symbols.join(graph.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "kind", F.coalesce("qualified_name", "name").alias("qualified_name"), "signature", "start_line")


def diff_symbols(before: Graph, after: Graph) -> DataFrame:
    """(change, path, kind, qualified_name, old_path): by path, kind and qualified name; a shifted line is no change.

    Keys with several symbols on a side are ambiguous. One removed and one added symbol of one kind and
    name, with equal signatures or one missing, moved.
    """
    keys = ["path", "kind", "qualified_name"]
    side = lambda g, p: _symbol_rows(g).groupBy(*keys).agg(F.count("*").alias(f"n{p}"), F.min("signature").alias(f"s{p}"))
    both = side(before, "a").join(side(after, "b"), keys, "full_outer")
    kind = (
        F.when((F.col("na") > 1) | (F.col("nb") > 1), F.when(F.col("na").eqNullSafe(F.col("nb")) & F.col("sa").eqNullSafe(F.col("sb")), F.lit(None).cast("string")).otherwise("ambiguous"))
        .when(F.col("na").isNull(), "added").when(F.col("nb").isNull(), "removed").when(~F.col("sa").eqNullSafe(F.col("sb")), "modified")
    )
    rows = both.withColumn("change", kind).where("change is not null")
    part = lambda c, s: rows.where(F.col("change") == c).select("kind", "qualified_name", F.struct("path", F.col(s).alias("signature")).alias("item"))
    met = _moves(part("removed", "sa"), part("added", "sb"), ["kind", "qualified_name"]).where("n_before = 1 and n_after = 1")
    fits = F.col("old.signature").isNull() | F.col("new.signature").isNull() | (F.col("old.signature") == F.col("new.signature"))
    moved = met.where(fits).select(F.lit("moved").alias("change"), F.col("new.path").alias("path"), "kind", "qualified_name", F.col("old.path").alias("old_path"))
    gone = moved.select("path", "kind", "qualified_name").unionByName(moved.select(F.col("old_path").alias("path"), "kind", "qualified_name"))
    plain = rows.join(gone, keys, "left_anti").select("change", *keys, F.lit(None).cast("string").alias("old_path"))
    return plain.unionByName(moved)


def natural_keys(graph: Graph) -> DataFrame:
    """(id, key): what a vertex is called in any snapshot."""
    files = graph.files.select("id", F.concat(F.lit("file|"), "path").alias("key"))
    symbols = graph.symbols.join(graph.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", F.concat_ws("|", F.lit("symbol"), "path", "kind", F.coalesce("qualified_name", "name")).alias("key"))
    dirs = graph.directories.select("id", F.concat(F.lit("directory|"), "path").alias("key"))
    return files.unionByName(symbols).unionByName(dirs)


def keyed_edges(graph: Graph, sources: DataFrame | None = None, *also: str) -> DataFrame:
    """Edges by the keys of their ends, with the columns ``also``; edges with an end that has no key are left out.

    ``sources`` (id, key) are the keys that sources can have, where these are known to be some of all.
    """
    keys = natural_keys(graph)
    side = lambda p, k: k.select(F.col("id").alias(f"{p}_id"), F.col("key").alias(f"{p}_key"))
    return graph.edges.join(side("source", keys if sources is None else sources), "source_id").join(side("target", keys), "target_id").select("source_key", "target_key", "relationship_type", "confidence", metadata_key(F.col("metadata")).alias("detail"), *also)


def diff_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, source_key, target_key, relationship_type) of keyed edges; parallel ones are ambiguous where they differ."""
    return diff_sides(before.withColumn("side", F.lit("before")).unionByName(after.withColumn("side", F.lit("after"))))


def diff_sides(edges: DataFrame) -> DataFrame:
    """As ``diff_edges``, of keyed edges of both sides (side: before or after); what one task holds of an edge's two sides is shuffled as one row."""
    keys = ["source_key", "target_key", "relationship_type"]
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("confidence", "detail"))))
    both = edges.groupBy(*keys).agg(of("before").alias("ea"), of("after").alias("eb"))
    x, y, na, nb = F.get("ea", F.lit(0)), F.get("eb", F.lit(0)), F.size("ea"), F.size("eb")
    differ = (F.abs(x["confidence"] - y["confidence"]) > 1e-6) | ~x["detail"].eqNullSafe(y["detail"])
    kind = F.when((na > 1) | (nb > 1), F.when(F.col("ea").eqNullSafe(F.col("eb")), F.lit(None).cast("string")).otherwise("ambiguous")).when(na == 0, "added").when(nb == 0, "removed").when(differ, "modified")
    return both.withColumn("change", kind).where("change is not null").select("change", *keys)


def affected(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(source_key, via_key, relationship_type): sources of keyed edges to changed keys (key), unless changed themselves; the last edge of each."""
    hit = edges.join(changed.select(F.col("key").alias("target_key")).distinct(), "target_key", "left_semi").join(changed.select(F.col("key").alias("source_key")), "source_key", "left_anti")
    return hit.groupBy("source_key").agg(F.max(F.struct("target_key", "relationship_type")).alias("last")).select("source_key", F.col("last.target_key").alias("via_key"), F.col("last.relationship_type").alias("relationship_type"))


def qualified(rows: DataFrame, complete: bool) -> DataFrame:
    return rows.withColumn("qualification", F.lit("confirmed" if complete else "incomplete_analysis"))


def totals(rows: DataFrame, by: Column | str = "change") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("changes"))
