"""Composed reports: architecture, health, verification, risk, post-change and pre-change."""

from __future__ import annotations

import os
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import changes, classify, history, lookup, structure, traverse, usage
from ..schema import COMPLETE, EXCERPT_LINES, IMPACT_DEPTH, REPORT_LIMIT, Graph
from ..session import checkpoint
from ..sources import config
from . import assurance


def import_pairs(graph: Graph) -> DataFrame:
    return graph.edges.where("relationship_type = 'imports'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))


def architecture(graph: Graph, limit: int = REPORT_LIMIT) -> dict[str, DataFrame]:
    """Sections of the architecture report; each list is cut at ``limit`` and says its total."""
    pairs = import_pairs(graph)
    modules = graph.files.where(F.col("path").rlike(r"\.pyi?$")).select(F.col("id").alias("node"))
    found = structure.packages(graph.files)
    out = {
        "summary": lookup.summary(graph),
        "modules": structure.limited(traverse.degrees(pairs, modules), [F.desc("fan_in"), F.desc("fan_out"), "node"], limit),
        "packages": structure.limited(structure.package_modules(graph.files, found), ["package"], limit),
        "cycles": structure.limited(traverse.cycles(pairs), [F.desc("size"), "component"], limit),
        "integrity": structure.limited(structure.integrity(graph), ["finding", "id", "points_at"], limit),
    }
    if graph.imports is not None:
        out["unresolved_imports"] = structure.limited(structure.unresolved_imports(graph.files, graph.imports), ["file_id", "ordinal"], limit)
    return out


def health(graph: Graph, cache_state: str = "fresh") -> DataFrame:
    """One row: counts, findings and a status: healthy, degraded (findings or errors), incomplete, stale."""
    found = structure.integrity(graph).agg(F.count("*").alias("findings"))
    errors = graph.errors.agg(F.count("*").alias("errors")) if graph.errors is not None else found.select(F.lit(0).alias("errors"))
    rows = graph.files.agg(F.count("*").alias("files")).crossJoin(graph.symbols.agg(F.count("*").alias("symbols"))).crossJoin(found).crossJoin(errors)
    status = F.when(F.lit(graph.status != "analyzed"), "incomplete").when(F.lit(cache_state != "fresh"), "stale").when((F.col("findings") > 0) | (F.col("errors") > 0), "degraded").otherwise("healthy")
    return rows.withColumn("cache", F.lit(cache_state)).withColumn("status", status)


def tests_for(graph: Graph, targets: DataFrame) -> dict[str, DataFrame]:
    """direct, heuristic and unknown test associations of targets (target_id)."""
    is_test = usage.is_test_file(F.col("path"))
    direct = usage.direct_tests(graph, targets, is_test)
    named = graph.vertices().join(targets, F.col("id") == F.col("target_id"), "left_semi").select(F.col("id").alias("target_id"), paths.stem_of(F.when(F.col("kind") == "symbol", paths.name_of(F.col("path"))).otherwise(F.col("name"))).alias("stem"))
    tests = graph.files.where(is_test).select(F.col("path").alias("test_path"))
    # A symbol's target goes by the stem of its file; its own name is looked for in the tests.
    symbols = graph.symbols.join(targets.select(F.col("target_id").alias("id")), "id", "left_semi").select(F.col("id").alias("target_id"), "name")
    by_symbol = usage.tests_by_symbol(usage.names_in_tests(graph), symbols).drop("matched").join(direct.select("test_path", "target_id"), ["test_path", "target_id"], "left_anti")
    by_name = usage.named_tests(tests, named, direct)
    heuristic = by_name.unionByName(by_symbol.join(by_name.select("test_path", "target_id"), ["test_path", "target_id"], "left_anti"))
    return {"direct": direct, "heuristic": heuristic, "unknown": usage.untested(targets, direct, heuristic)}


def checklist(graph: Graph, roots: DataFrame, max_depth: int = IMPACT_DEPTH, hit: DataFrame | None = None) -> DataFrame:
    """(rank, category, item, detail) of what to run and to look at after a change of ``roots`` (root); ``hit``: their impact, if it is known.

    1 tests linked to what is affected, 2 tests named after it, 3 areas without any test, 4 caveats; two or more
    tests make a run of all of them.
    """
    hit = traverse.change_impact(graph, roots, max_depth) if hit is None else hit
    affected = hit.select(F.col("node").alias("target_id")).union(roots.select("root")).distinct()
    met = tests_for(graph, affected)
    grouped = lambda df: df.groupBy("test_path").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ", ").alias("detail"))
    direct = grouped(met["direct"]).select(F.lit(1).alias("rank"), F.lit("direct_test").alias("category"), F.col("test_path").alias("item"), "detail")
    other = grouped(met["heuristic"]).select(F.lit(2).alias("rank"), F.lit("related_test").alias("category"), F.col("test_path").alias("item"), "detail")
    areas = met["unknown"].select(F.lit(3).alias("rank"), F.lit("unverified_area").alias("category"), F.col("target_id").alias("item"), F.lit("no test association").alias("detail"))
    every = direct.unionByName(other)
    run = every.select("item").distinct().agg(F.array_sort(F.collect_set("item")).alias("t")).where(F.size("t") >= 2).select(F.lit(1).alias("rank"), F.lit("consolidated_run").alias("category"), F.array_join("t", " ").alias("item"), F.lit("all associated tests").alias("detail"))
    caveat = graph.files.sparkSession.range(1).select(F.lit(4).alias("rank"), F.lit("caveat").alias("category"), F.lit("static_analysis").alias("item"), F.lit("dynamic dispatch and runtime configuration are not seen" if graph.status in COMPLETE else "the analysis is incomplete").alias("detail"))
    return every.unionByName(run).unionByName(areas).unionByName(caveat)


def risk_facts(graph: Graph, roots: DataFrame, max_depth: int = IMPACT_DEPTH, hit: DataFrame | None = None) -> DataFrame:
    """(fact, node, text): roots, direct and downstream components with their paths, tests, package crossings."""
    hit = traverse.change_impact(graph, roots, max_depth) if hit is None else hit
    named = graph.vertices().select(F.col("id").alias("node"), "name")
    text = F.array_join(F.transform("path", lambda s: F.concat(s["relationship_type"], F.lit(":"), s["name"])), " => ")
    # A root that another root reaches is listed with what is downstream.
    fact = F.when(F.col("classification") == "direct", "direct_component").otherwise("downstream_component")
    spread = hit.select(fact.alias("fact"), "node", text.alias("text"))
    own = roots.select(F.col("root").alias("node")).join(named, "node", "left").select(F.lit("changed_root").alias("fact"), "node", F.coalesce("name", "node").alias("text"))
    tests = usage.direct_tests(graph, hit.select(F.col("node").alias("target_id")).union(roots.select("root")).distinct(), usage.is_test_file(F.col("path")))
    tested = tests.select(F.lit("associated_test").alias("fact"), F.col("target_id").alias("node"), F.col("test_path").alias("text"))
    of_file = structure.package_of(graph.files, structure.packages(graph.files)).select(F.col("id"), "package")
    cross = structure.cross_package(structure.endpoint_packages(graph, of_file)).where("class = 'cross'").join(roots.select(F.col("root").alias("source_id")), "source_id", "left_semi")
    crossing = cross.select(F.lit("package_crossing").alias("fact"), F.col("source_id").alias("node"), F.concat_ws(" -> ", "source_package", "target_package").alias("text")).distinct()
    return own.unionByName(spread).unionByName(tested).unionByName(crossing)


def risk_concerns(facts: DataFrame, incomplete: bool = False) -> DataFrame:
    """(severity, concern, count, evidence): three or more downstream components, none tested, package crossings; evidence up to 10."""
    first = facts.select("fact", "node").distinct().withColumn("r", F.row_number().over(Window.partitionBy("fact").orderBy("node"))).where("r <= 10")
    shown = first.groupBy("fact").agg(F.array_sort(F.collect_list("node")).alias("evidence"))
    by = facts.groupBy("fact").agg(F.count("*").alias("n")).join(shown, "fact")
    wide = by.where("fact = 'downstream_component'").select(F.when(F.col("n") >= 3, "warning").otherwise("info").alias("severity"), F.lit("downstream_impact").alias("concern"), "n", "evidence")
    cross = by.where("fact = 'package_crossing'").select(F.lit("warning").alias("severity"), F.lit("package_boundary").alias("concern"), "n", "evidence")
    tests = facts.agg(F.count_if(F.col("fact") == "associated_test").alias("n")).where("n = 0").select(F.lit("warning").alias("severity"), F.lit("missing_tests").alias("concern"), "n", F.array().cast("array<string>").alias("evidence"))
    out = wide.unionByName(cross).unionByName(tests)
    if incomplete:
        out = out.unionByName(facts.sparkSession.range(1).select(F.lit("error").alias("severity"), F.lit("incomplete_analysis").alias("concern"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<string>").alias("evidence")))
    rank = F.coalesce(*[F.when(F.col("severity") == s, i) for i, s in enumerate(("blocker", "error", "warning", "info"))])
    return out.withColumn("severity_rank", rank)


def post_change(before: Graph, after: Graph, changed_paths: DataFrame, before_prints: DataFrame, after_prints: DataFrame, rules: list[dict] | None = None) -> dict[str, DataFrame]:
    """Everything to know after a change of ``changed_paths`` (path); without them, pass the paths of a status table."""
    sized = lambda g, p: g.files.select("path", "size").join(p.select("path", "content_hash"), "path", "left")
    roots = after.files.join(changed_paths.select("path"), "path", "left_semi").select(F.col("id").alias("root"))
    hit = checkpoint(traverse.change_impact(after, roots))
    facts = risk_facts(after, roots, hit=hit)
    out = {
        "file_diff": changes.diff_files(sized(before, before_prints), sized(after, after_prints)),
        "symbol_diff": changes.diff_symbols(before, after),
        "edge_diff": changes.diff_edges(changes.keyed_edges(before), changes.keyed_edges(after)),
        "impact": hit,
        "checklist": checklist(after, roots, hit=hit),
        "risk": risk_concerns(facts, after.status not in COMPLETE),
    }
    if rules:
        out["rules"] = structure.evaluate_rules(after, rules)
    return out


def after_change(graph: Graph, roots: DataFrame, rules: list[dict] | None = None, policy: dict | None = None, state: str = "current", comparison: str = "not_performed", failures: tuple[str, ...] = (), max_depth: int = IMPACT_DEPTH) -> dict[str, DataFrame]:
    """Impact, checklist, risk, boundaries and rules after a change of ``roots`` (root), and ``summary``, one row with counts and status.

    ``state`` is the freshness of the analysis and ``comparison`` how comparing with an earlier state went (not_performed, completed,
    incomplete, blocked, failed); ``failures`` names stages that couldn't run. Status: blocked, failed, incomplete, partial (there are findings), success. The impact is walked once.
    """
    hit = checkpoint(traverse.change_impact(graph, roots, max_depth))
    told = assurance.assess(graph, roots, rules=(policy or {}).get("rules"), freshness=state, max_depth=max_depth, hit=hit)
    out = {"impact": hit, "checklist": told["checklist"], "risk": told["concerns"], "missing_evidence": told["missing_evidence"]}
    counts = {"risk_concerns": out["risk"].where("severity in ('blocker', 'error', 'warning')")}
    if policy is not None:
        of = structure.package_of(graph.files, structure.packages(graph.files)).select("id", "package")
        out["boundaries"] = structure.policy(structure.patterns(structure.endpoint_packages(graph, of)), policy.get("rules", []), policy.get("default_policy", "unrestricted"))
        counts["policy_violations"] = out["boundaries"].where("decision in ('deny', 'prohibit')")
    if rules:
        out["rules"] = structure.evaluate_rules(graph, rules)
        counts["rule_violations"] = out["rules"].where("outcome = 'violation'")
    one = hit.agg(F.count_if(F.col("classification") == "direct").alias("direct"), F.count_if(F.col("classification") == "downstream").alias("downstream")).crossJoin(roots.agg(F.count_distinct("root").alias("roots")))
    for name in ("risk_concerns", "policy_violations", "rule_violations"):
        one = one.crossJoin(counts[name].agg(F.count("*").alias(name))) if name in counts else one.withColumn(name, F.lit(0).cast("bigint"))
    found = F.col("risk_concerns") + F.col("policy_violations") + F.col("rule_violations") > 0
    if comparison == "blocked":
        status = F.lit("blocked")
    elif failures or comparison == "failed":
        status = F.lit("failed")
    elif comparison == "incomplete" or state == "incomplete" or graph.status not in COMPLETE:
        status = F.lit("incomplete")
    else:
        status = F.when(found, "partial").otherwise("success")
    out["summary"] = one.withColumns({"freshness": F.lit(state), "comparison": F.lit(comparison), "status": status})
    return out


def pre_change(graph: Graph, contents: DataFrame, target: str, max_lines: int = EXCERPT_LINES) -> dict[str, DataFrame]:
    """Before a change of ``target``: what it is, its source and header, and its impact. ``contents``: path, content."""
    spark = graph.files.sparkSession
    resolved = lookup.resolve_targets(graph, spark.createDataFrame([(target,)], "target string"))
    found = resolved.where("status = 'resolved'").select("id")
    symbols = graph.symbols.join(found, "id", "left_semi").join(graph.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    text = contents.select("path", F.col("content").cast("string").alias("content"))
    source = lookup.header_status(lookup.excerpts(symbols.join(text, "path", "left"), max_lines))
    return {"resolution": resolved, "source": source, "impact": traverse.impact(graph, found.select(F.col("id").alias("root")))}


def preflight(root: str, scan: Callable[[], tuple[DataFrame, DataFrame]] | None = None, config_path: str | None = None, global_path: str | None = None, analysed: bool = False, supported: tuple[str, ...] = ("Python",)) -> dict:
    """Whether a tree can be analysed, and what it holds: readiness (blocked, ready_with_limitations, ready), checks, configuration, inventory, languages, diagnostics.

    ``scan`` gives (directories, files) of the tree and is called only where it can be read; ``analysed`` says whether a snapshot exists. A path that doesn't exist, is no directory or
    can't be read, a configuration with errors and a failing scan block. Languages without a parser and trees without files or supported sources limit.
    """
    checks = {"exists": os.path.exists(root), "is_directory": os.path.isdir(root), "readable": os.access(root, os.R_OK | os.X_OK), "version_control": os.path.exists(os.path.join(root, ".git"))}
    diagnostics, limits = [], []

    def tell(severity: str, code: str, message: str) -> None:
        diagnostics.append({"severity": severity, "code": code, "message": message})

    for check, code in (("exists", "REPOSITORY_NOT_FOUND"), ("is_directory", "REPOSITORY_NOT_A_DIRECTORY"), ("readable", "REPOSITORY_INACCESSIBLE")):
        if not checks[check]:
            tell("blocker", code, root)
            break
    out = {"checks": checks, "configuration": {"status": "unavailable"}, "inventory": {"directories": 0, "files": 0, "source_files": 0}, "languages": {}, "diagnostics": diagnostics, "limitations": limits}
    if not diagnostics:
        limits += [] if checks["version_control"] else ["no version control"]
        limits += [] if analysed else ["not analysed yet"]
        out["configuration"] = config.audit(config_path, global_path)
        diagnostics += out["configuration"]["diagnostics"]
    if not diagnostics and scan is not None:
        try:
            directories, files = scan()
            counts = files.groupBy(classify.language(F.col("path")).alias("language")).agg(F.count("*").alias("n")).orderBy("language").collect()
            out["inventory"] = {"directories": directories.count(), "files": sum(r["n"] for r in counts), "source_files": sum(r["n"] for r in counts if r["language"])}
        except (OSError, PySparkException, Py4JJavaError) as error:
            tell("blocker", "SCAN_ERROR", str(error).split("\n")[0])
        else:
            out["languages"] = {r["language"]: {"files": r["n"], "supported": r["language"] in supported} for r in counts if r["language"]}
            for name, found in out["languages"].items():
                if not found["supported"]:
                    tell("warning", "UNSUPPORTED_LANGUAGE", f"{found['files']} files of {name} have no parser")
            if not out["inventory"]["files"]:
                tell("info", "EMPTY_REPOSITORY", root)
                limits.append("no files")
            elif out["languages"] and not any(found["supported"] for found in out["languages"].values()):
                tell("warning", "NO_SUPPORTED_SOURCES", root)
    severities = {each["severity"] for each in diagnostics}
    out["readiness"] = "blocked" if severities & {"blocker", "error"} else "ready_with_limitations" if "warning" in severities or limits else "ready"
    out["ready"] = out["readiness"] != "blocked"
    return out


def freshness(reason: str, status: str, has_errors: bool) -> str:
    """current, stale, incomplete or indeterminate; changed files come before errors, which may be of files that changed."""
    if reason == "files_changed":
        return "stale"
    if reason != "fresh":
        return "indeterminate"
    return "current" if status in COMPLETE and not has_errors else "incomplete"


def outcome(diagnostics: DataFrame) -> DataFrame:
    return history.outcomes(diagnostics.withColumn("all", F.lit(1)), ["all"]).drop("all")
