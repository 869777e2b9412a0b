"""What to verify after a change and what makes it risky: tests, checklist, facts, concerns and gaps, all as rows.

Statements are built where they are listed; lists that stand in one row are cut at a limit and carry their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import structure, traverse, usage
from ..operators.order import first_within
from ..schema import COMPLETE, IMPACT_DEPTH, REPORT_LIMIT, Graph
from ..session import checkpoint

# Categories of the checklist in their order, severities in theirs, how much a concern shows.
CHECKLIST = ("detected_structural", "heuristic_recommendation", "additional_verification", "unverified_area")
SEVERITIES = ("blocker", "error", "warning", "info")
SHOWN_FACTS, SHOWN_EVIDENCE, BROAD = 10, 5, 3


def _place(column: str, values) -> Column:
    return F.coalesce(*[F.when(F.col(column) == v, i) for i, v in enumerate(values, 1)], F.lit(99))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def change_targets(roots: DataFrame, hit: DataFrame) -> DataFrame:
    """(target_id, target_kind): what was changed (root), and what the change reaches in more than one step (downstream)."""
    own = roots.select(F.col("root").alias("target_id")).distinct()
    reached = hit.where("classification = 'downstream'").select(F.col("node").alias("target_id")).distinct()
    return own.withColumn("target_kind", F.lit("root")).unionByName(reached.join(own, "target_id", "left_anti").withColumn("target_kind", F.lit("downstream")))


def _test_names(graph: Graph, tests: DataFrame) -> DataFrame:
    """(test_path, matched, key): the names that the symbols of test files test.

    ``test_x`` and ``x_test`` test x; ``test_x_y`` tests x and x_y, so a name is looked up by each of its beginnings
    that an underscore ends.
    """
    rows = graph.symbols.join(tests.select("file_id", "test_path"), "file_id").select("test_path", F.col("name").alias("matched"), F.lower("name").alias("low"))
    rest = F.split(F.substr("low", F.lit(6)), "_")
    begun = F.when(F.col("low").startswith("test_"), F.transform(F.sequence(F.lit(1), F.size(rest)), lambda n: F.array_join(F.slice(rest, 1, n), "_")))
    ended = F.when(F.col("low").endswith("_test"), F.array(F.regexp_replace("low", "_test$", "")))
    none = F.array().cast("array<string>")
    keys = F.array_distinct(F.concat(F.coalesce(begun, none), F.coalesce(ended, none)))
    return rows.select("test_path", "matched", F.explode(keys).alias("key")).where("key <> ''").distinct()


def associations(graph: Graph, targets: DataFrame, is_test: Column | None = None, types=None) -> DataFrame:
    """One row for each test file and target: classification (direct, heuristic, unknown), rule, types, directions, evidence, confidence.

    ``targets``: target_id, target_kind. A test is direct where an edge joins it and the target, either way; heuristic where its file is
    named after the target's, else where it holds a test of the target's name (of a file: of any symbol in it). Targets without a test are unknown, with no
    test_path. Targets that are no vertex go by their id.
    """
    is_test = usage.is_verification_test() if is_test is None else is_test
    named = graph.vertices().select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("path").alias("target_path"), F.col("kind").alias("vertex"), "file_id")
    known = targets.select("target_id", "target_kind").dropDuplicates(["target_id"]).join(named, "target_id", "left").withColumn("target_name", F.coalesce("target_name", "target_id"))
    tests = graph.files.where(is_test).select(F.col("id").alias("file_id"), F.col("path").alias("test_path"))

    edges = usage.test_edges(graph, known, is_test, types).join(known.select("target_id", "target_name"), "target_id")
    kind, test, name = F.col("relationship_type"), F.col("test_path"), F.col("target_name")
    told = F.when(F.col("direction") == "outgoing_from_test", F.concat(test, F.lit(" -["), kind, F.lit("]-> "), name)).otherwise(F.concat(name, F.lit(" -["), kind, F.lit("]-> "), test))
    # At most one entry for each type and direction: a bounded list.
    every = lambda c: F.array_sort(F.collect_set(c))
    direct = edges.groupBy("test_path", "target_id").agg(
        F.concat(F.lit("structural_"), F.array_join(every("relationship_type"), "_")).alias("rule"), F.array_join(every("relationship_type"), ", ").alias("types"),
        F.array_join(every("direction"), ", ").alias("directions"), F.array_join(every(told), "; ").alias("evidence"),
    )

    stem = F.lower(paths.stem_of(paths.name_of(F.col("test_path"))))
    stems = F.array_distinct(F.array(stem, F.when(stem.startswith("test_"), F.substr(stem, F.lit(6))).otherwise(stem), F.regexp_replace(stem, "_test$", "")))
    wanted = known.where("target_path is not null").select("target_id", F.lower(paths.stem_of(paths.name_of(F.col("target_path")))).alias("key"))
    by_file = tests.select("test_path", F.explode(stems).alias("key")).join(wanted, "key").select("test_path", "target_id", F.lit(0).alias("rung"), F.lit(None).cast("string").alias("matched")).distinct()
    held = known.where("vertex = 'file'").select("target_id", F.col("target_id").alias("file_id")).join(graph.symbols.select("file_id", "name"), "file_id")
    names = held.select("target_id", F.lower("name").alias("key")).unionByName(known.where("vertex = 'symbol'").select("target_id", F.lower("target_name").alias("key"))).distinct()
    by_name = _test_names(graph, tests).join(names, "key").groupBy("test_path", "target_id").agg(F.min("matched").alias("matched")).withColumn("rung", F.lit(1))
    best = by_file.unionByName(by_name).groupBy("test_path", "target_id").agg(F.min(F.struct("rung", "matched")).alias("b"))
    heuristic = best.join(direct.select("test_path", "target_id"), ["test_path", "target_id"], "left_anti").select(
        "test_path", "target_id", F.when(F.col("b.rung") == 0, "naming_convention").otherwise("symbol_name_match").alias("rule"),
        F.when(F.col("b.rung") == 0, F.concat(F.lit("named after the target: "), test)).otherwise(F.concat(F.lit("test of the target's name: "), F.col("b.matched"))).alias("evidence"),
    )

    found = _union([direct.withColumns({"classification": F.lit("direct"), "confidence": F.lit("high")}), heuristic.withColumns({"classification": F.lit("heuristic"), "confidence": F.lit("medium")})])
    out = known.select("target_id", "target_name", "target_kind").join(found, "target_id", "left")
    return out.withColumns({"classification": F.coalesce("classification", F.lit("unknown")), "rule": F.coalesce("rule", F.lit("unassociated")), "confidence": F.coalesce("confidence", F.lit("none"))})


def _grouped(rows: DataFrame, key: str, value: str, limit: int) -> DataFrame:
    """(key, n, firsts): the number of distinct values of each key, and the first ``limit`` of them in order."""
    first = first_within(rows.select(key, value).distinct(), key, value, limit=limit)
    return first.groupBy(key).agg(F.max("total").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("position", value))), lambda x: x[value]).alias("firsts"))


def checklist(met: DataFrame, asked: DataFrame | None = None, status: str = "analyzed", errors: int = 0, freshness: str = "current", limit: int = REPORT_LIMIT) -> DataFrame:
    """(rank, category, item_id, classification, test_path, n_targets, targets, evidence, command) of what to run and to look at.

    ``met`` is what ``associations`` found, ``asked`` a change set with its states (path, status; ``lookup.changeset_targets``). One item a test with
    its command; one for each changed target without a test; a run of all tests where there are two or more; and one for each reason to doubt: unresolved
    paths, an incomplete analysis, one that isn't current, targets without tests. ``targets`` and ``evidence`` hold the first ``limit``
    names, ``n_targets`` counts all; the command of the common run is null where it would name more than ``limit`` files, as each has its own.
    """
    spark = met.sparkSession
    ranked = met.where("test_path is not null").withColumn("level", F.when(F.col("classification") == "direct", 0).otherwise(1))
    level = ranked.groupBy("test_path").agg(F.min("level").alias("level"))
    # A test with a direct target is listed by its direct targets alone.
    rows = ranked.join(level, ["test_path", "level"])
    tests = level.join(_grouped(rows, "test_path", "target_name", limit), "test_path").join(_grouped(rows, "test_path", "evidence", limit).select("test_path", F.col("firsts").alias("evidence")), "test_path")
    structural = F.col("level") == 0
    each = tests.select(
        F.when(structural, CHECKLIST[0]).otherwise(CHECKLIST[1]).alias("category"), F.concat(F.when(structural, "structural:").otherwise("heuristic:"), F.col("test_path")).alias("item_id"),
        F.when(structural, "direct").otherwise("heuristic").alias("classification"), "test_path", F.col("n").alias("n_targets"), F.col("firsts").alias("targets"), "evidence", F.concat(F.lit("pytest "), F.col("test_path")).alias("command"),
    )

    def item(category: str, name: Column | str, kind: str, df: DataFrame) -> DataFrame:
        return df.withColumns({"category": F.lit(category), "item_id": F.lit(name) if isinstance(name, str) else name, "classification": F.lit(kind)})

    one = spark.range(1)
    alone = met.where("classification = 'unknown'").select("target_name", "target_kind").distinct()
    missing = alone.where("target_kind = 'root'").select(F.col("target_name").alias("only"), F.lit(1).cast("bigint").alias("n_targets"), F.array("target_name").alias("targets"))
    parts = [each, item(CHECKLIST[2], F.concat(F.lit("missing_test:"), F.col("only")), "suggested", missing).drop("only")]

    as_one = lambda df: df.withColumn("all", F.lit(1))
    files = _grouped(as_one(level), "all", "test_path", limit).where("n >= 2")
    command = F.when(F.col("n") <= limit, F.concat(F.lit("pytest "), F.array_join("firsts", " ")))
    run = files.select("all", command.alias("command")).join(_grouped(as_one(ranked), "all", "target_name", limit), "all").select("command", F.col("n").alias("n_targets"), F.col("firsts").alias("targets"))
    parts.append(item(CHECKLIST[2], "consolidated_test_run", "suggested", run))

    if asked is not None:
        lost = asked.where("status <> 'resolved'").select("path", "status").distinct()
        lost = lost.select(F.coalesce("path", F.lit("")).alias("only"), F.lit(1).cast("bigint").alias("n_targets"), F.array(F.coalesce("path", F.lit(""))).alias("targets"), F.array("status").alias("evidence"))
        parts.append(item(CHECKLIST[3], F.concat(F.lit("unresolved_path:"), F.col("only")), "unknown", lost).drop("only"))
    doubts = [] if status in COMPLETE and not errors else ["incomplete_analysis"]
    doubts += [] if freshness == "current" else [f"{freshness}_freshness"]
    for doubt in doubts:
        parts.append(item(CHECKLIST[3], doubt, "unknown", one.select(F.lit(0).cast("bigint").alias("n_targets"), F.array(F.lit(status if doubt == "incomplete_analysis" else freshness)).alias("evidence"))))
    parts.append(item(CHECKLIST[3], "unassociated_targets", "unknown", _grouped(as_one(alone), "all", "target_name", limit).select(F.col("n").alias("n_targets"), F.col("firsts").alias("targets"))))
    empty = F.array().cast("array<string>")
    out = _union(parts).withColumns({"rank": _place("category", CHECKLIST), "targets": F.coalesce("targets", empty), "evidence": F.coalesce("evidence", empty)})
    return out.select("rank", "category", "item_id", "classification", "test_path", "n_targets", "targets", "evidence", "command")


def facts(graph: Graph, roots: DataFrame, hit: DataFrame, met: DataFrame, *, of_file: DataFrame | None = None, rules: list[dict] | None = None, diff: DataFrame | None = None, asked: DataFrame | None = None, errors: int = 0, freshness: str = "current") -> DataFrame:
    """(category, fact_id, kind, name, path, statement, source_package, target_package, policy, rule_id): what is known of a change.

    ``hit`` is the impact of ``roots`` (root), ``met`` the tests of ``change_targets``. Further sources: ``diff`` (change, path, old_path),
    ``asked`` (path, status), ``rules`` of the package policy; ``of_file`` (id, package) replaces packages found by their ``__init__.py``.
    """
    ends = graph.vertices().select(F.col("id").alias("node"), "name", "path", "file_id")
    text = F.concat_ws
    own = roots.select(F.col("root").alias("node")).distinct().join(ends, "node", "left").withColumn("name", F.coalesce("name", "node"))
    reached = hit.select("node", "classification", "min_depth", F.col("path").alias("steps")).join(ends, "node", "left").withColumn("name", F.coalesce("name", "node"))
    near = F.col("classification") == "direct"
    parts = [
        own.select(F.lit("changed_entity").alias("category"), F.lit("root").alias("kind"), F.concat(F.lit("root:"), "node").alias("fact_id"), "name", "path", text(" ", F.lit("changed:"), "name").alias("statement")),
        reached.select(F.lit("affected_component").alias("category"), F.when(near, "direct").otherwise("downstream").alias("kind"), F.concat(F.when(near, "direct_impact:").otherwise("downstream:"), F.col("node")).alias("fact_id"), "name", "path", F.concat(F.lit("affected at depth "), F.col("min_depth").cast("string"), F.lit(": "), F.col("name")).alias("statement")),
        reached.where(F.size("steps") > 0).select(
            F.lit("dependency_path").alias("category"), F.lit("path").alias("kind"), F.concat(F.lit("path:"), "node").alias("fact_id"), "name", "path",
            F.array_join(F.transform("steps", lambda s: F.concat(F.lit("-["), s["relationship_type"], F.lit("]-> "), s["name"])), " => ").alias("statement"),
        ),
    ]
    if diff is not None:
        changed = diff.where(F.col("change").isin("modified", "added", "removed", "moved"))
        parts.append(changed.select(F.lit("changed_entity").alias("category"), F.lit("comparison").alias("kind"), F.concat(F.lit("comparison:"), "change", F.lit("_file:"), "path").alias("fact_id"), F.lit(None).cast("string").alias("name"), "path", text(" ", "change", "path", F.when(F.col("change") == "moved", text(" ", F.lit("from"), "old_path"))).alias("statement")))
    if asked is not None:
        lost = asked.where("status <> 'resolved'").select(F.coalesce("path", F.lit("")).alias("path"), "status").distinct()
        parts.append(lost.select(F.lit("changed_entity").alias("category"), F.lit("unresolved").alias("kind"), F.concat(F.lit("unresolved_input:"), "path").alias("fact_id"), F.lit(None).cast("string").alias("name"), "path", text(" ", F.lit("not resolved:"), "path", "status").alias("statement")))

    tested = met.where("test_path is not null").groupBy("test_path").agg(F.min(F.when(F.col("classification") == "direct", 0).otherwise(1)).alias("level"), F.count_distinct("target_name").alias("n"))
    kind = F.when(F.col("level") == 0, "structural").otherwise("heuristic")
    parts.append(tested.select(F.lit("test_association").alias("category"), F.concat(F.lit("test_"), kind).alias("kind"), F.concat(F.lit("test_"), kind, F.lit(":"), kind, F.lit(":"), "test_path").alias("fact_id"), F.lit(None).cast("string").alias("name"), F.col("test_path").alias("path"), F.concat("test_path", F.lit(" tests "), F.col("n").cast("string"), F.lit(" targets")).alias("statement")))
    alone = met.where("classification = 'unknown'").select("target_name").distinct()
    parts.append(alone.select(F.lit("test_association").alias("category"), F.lit("untested").alias("kind"), F.concat(F.lit("unassociated_target:"), "target_name").alias("fact_id"), F.col("target_name").alias("name"), F.lit(None).cast("string").alias("path"), text(" ", F.lit("no test found for"), "target_name").alias("statement")))

    of_file = structure.package_of(graph.files, structure.packages(graph.files)).select("id", "package") if of_file is None else of_file
    touched = own.select("path").unionByName(reached.select("path")).where("path is not null").distinct()
    # All edges meet packages and the mark of the change alone, once a side; paths are looked up for those that cross next to it.
    homes = checkpoint(ends.join(of_file.select(F.col("id").alias("file_id"), "package").where("package is not null"), "file_id").join(touched.withColumn("touched", F.lit(True)), "path", "left").select("node", "package", "touched", "path"))
    side = lambda p: homes.select(F.col("node").alias(f"{p}_id"), F.col("package").alias(f"{p}_package"), F.col("touched").alias(f"{p}_touched"))
    crossing = graph.edges.select("source_id", "target_id").join(side("target"), "target_id").join(side("source"), "source_id").where("source_package <> target_package and (source_touched or target_touched)")
    at = lambda p: homes.select(F.col("node").alias(f"{p}_id"), F.col("path").alias(f"{p}_path"))
    near_ends = crossing.join(at("source"), "source_id").join(at("target"), "target_id").select("source_package", "target_package", "source_path", "target_path").distinct()
    judged = structure.policy(near_ends, rules or [])
    ways = F.concat("source_package", F.lit("->"), "target_package", F.lit(":"), "source_path", F.lit("->"), "target_path")
    parts.append(judged.select(F.lit("package_boundary").alias("category"), F.lit("crossing").alias("kind"), F.concat(F.lit("pkg_boundary:"), ways).alias("fact_id"), F.lit(None).cast("string").alias("name"), F.col("source_path").alias("path"), ways.alias("statement"), "source_package", "target_package", F.col("decision").alias("policy"), "rule_id"))

    state = graph.files.sparkSession.range(1)
    parts += [
        state.select(F.lit("freshness_state").alias("category"), F.lit("freshness").alias("kind"), F.lit("freshness_state").alias("fact_id"), F.lit(freshness).alias("name"), F.lit(f"freshness: {freshness}").alias("statement")),
        state.select(F.lit("analysis_status").alias("category"), F.lit("complete" if graph.status in COMPLETE and not errors else "incomplete").alias("kind"), F.lit("analysis_status").alias("fact_id"), F.lit(graph.status).alias("name"), F.lit(f"analysis: {graph.status}, errors: {errors}").alias("statement")),
    ]
    return _union(parts)


def concerns(found: DataFrame) -> DataFrame:
    """(severity_rank, severity, category, concern_id, n, facts, evidence) inferred from ``facts``.

    Each rests on facts of one kind: ``n`` counts them, ``facts`` are the ids of the first ten and ``evidence`` the statements of the first five, by fact_id. Downstream
    components are a warning from three on; every rule of the package policy that is broken is an error of its own.
    """
    denied = F.col("policy").isin("deny", "prohibit")
    reason = F.struct  # severity, category, concern_id
    of = lambda severity, category, concern: reason(F.lit(severity).alias("severity"), F.lit(category).alias("category"), (F.lit(concern) if isinstance(concern, str) else concern).alias("concern_id"))
    kind = F.col("kind")
    reasons = F.array(
        F.when(kind == "downstream", of("info", "broad_impact", "broad_downstream_impact")),
        F.when(kind == "untested", of("warning", "unverified_area", "unverified_affected_components")),
        F.when(kind == "crossing", of("info", "cross_package_impact", "cross_package_propagation")),
        F.when((kind == "crossing") & denied, of("error", "policy_violation", F.concat(F.lit("policy_violation:"), F.coalesce("rule_id", F.lit(""))))),
        F.when((kind == "crossing") & (F.col("policy") == "ambiguous"), of("warning", "policy_violation", "ambiguous_package_policy")),
        F.when((kind == "freshness") & (F.col("name") == "stale"), of("warning", "stale_analysis", "stale_analysis_risk")),
        F.when(kind == "incomplete", of("error", "incomplete_analysis", "incomplete_analysis_risk")),
        F.when(kind == "unresolved", of("error", "unresolved_input", "unresolved_inputs_risk")),
    )
    rows = found.select("fact_id", "statement", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("r")).select("fact_id", "statement", "r.*").distinct()
    first = first_within(rows, "concern_id", "fact_id", limit=SHOWN_FACTS)
    listed = F.array_sort(F.collect_list(F.struct("position", "fact_id", "statement")))
    out = first.groupBy("concern_id", "category", "severity").agg(F.max("total").alias("n"), listed.alias("l"))
    out = out.withColumn("severity", F.when((F.col("concern_id") == "broad_downstream_impact") & (F.col("n") >= BROAD), "warning").otherwise(F.col("severity")))
    return out.select(_place("severity", SEVERITIES).alias("severity_rank"), "severity", "category", "concern_id", "n", F.transform("l", lambda x: x["fact_id"]).alias("facts"), F.transform(F.slice("l", 1, SHOWN_EVIDENCE), lambda x: x["statement"]).alias("evidence"))


def missing_evidence(found: DataFrame) -> DataFrame:
    """(category, item_id, n) of what the facts leave open: tests, the graph, freshness, and each path that wasn't resolved."""
    gap = lambda category, item: F.struct(F.lit(category).alias("category"), (F.lit(item) if isinstance(item, str) else item).alias("item_id"))
    kind = F.col("kind")
    which = (
        F.when(kind == "untested", gap("test_associations", "missing_test_associations"))
        .when(kind == "incomplete", gap("structural_graph", "incomplete_analysis_evidence"))
        .when((kind == "freshness") & F.col("name").isin("stale", "indeterminate"), gap("repository_freshness", "freshness_uncertainty"))
        .when(kind == "unresolved", gap("input_resolution", F.col("fact_id")))
    )
    return found.select(which.alias("g")).where("g is not null").groupBy("g.category", "g.item_id").agg(F.count("*").alias("n"))


def assess(graph: Graph, roots: DataFrame, *, asked: DataFrame | None = None, diff: DataFrame | None = None, rules: list[dict] | None = None, freshness: str = "current", max_depth: int = IMPACT_DEPTH, hit: DataFrame | None = None, limit: int = REPORT_LIMIT) -> dict[str, DataFrame]:
    """Tests, checklist, facts, concerns and gaps of a change of ``roots`` (root), over one walk; ``summary`` is a row of their counts."""
    from ..session import checkpoint

    hit = checkpoint(traverse.change_impact(graph, roots, max_depth)) if hit is None else hit
    errors = 0 if graph.errors is None else graph.errors.count()
    met = checkpoint(associations(graph, change_targets(roots, hit)))
    found = checkpoint(facts(graph, roots, hit, met, rules=rules, diff=diff, asked=asked, errors=errors, freshness=freshness))
    out = {"associations": met, "checklist": checklist(met, asked, graph.status, errors, freshness, limit), "facts": found, "concerns": concerns(found), "missing_evidence": missing_evidence(found)}
    counts = {"direct": "direct", "downstream": "downstream", "untested": "untested", "crossings": "crossing", "unresolved": "unresolved"}
    tests = F.count_if(F.col("kind").isin("test_structural", "test_heuristic")).alias("tests")
    out["summary"] = found.agg(*[F.count_if(F.col("kind") == k).alias(c) for c, k in counts.items()], tests).withColumn("freshness", F.lit(freshness))
    return out
