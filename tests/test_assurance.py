"""Tests, checklists and risk of a change, and what their inputs mean."""

import os

import pytest
from graphloom.functions import tasks
from graphloom.operators import changes, lookup, metrics, search, traverse, usage
from graphloom.plans import assurance, reports
from graphloom.sources import runs
from pyspark.sql import functions as F

from tests.test_graph import graph


def f(path):
    return f"file:{path}"


@pytest.fixture(scope="module")
def tested(spark):
    files = ["app/__init__.py", "app/core.py", "app/util.py", "lib/__init__.py", "lib/deep.py", "lib/far.py", "tests/test_core.py", "tests/test_other.py", "x/far_test.py"]
    symbols = [("app/core.py", "Run", "class", 1, 5), ("lib/deep.py", "Dig", "function", 1, 5), ("tests/test_other.py", "test_dig_fast", "function", 1, 3), ("tests/test_other.py", "test_digger", "function", 4, 6), ("tests/test_other.py", "run_test", "function", 7, 8)]
    edges = [
        (f("tests/test_core.py"), f("app/core.py"), "imports", 1, 1.0), (f("tests/test_core.py"), f("app/core.py"), "calls", 2, 1.0), (f("app/core.py"), f("tests/test_core.py"), "references", 2, 1.0),
        (f("lib/deep.py"), f("app/core.py"), "imports", 1, 1.0), (f("lib/far.py"), f("lib/deep.py"), "imports", 1, 1.0),
    ]
    return graph(spark, files, symbols, edges)


def targets(spark, *rows):
    return spark.createDataFrame(list(rows), "target_id string, target_kind string")


def test_associations(spark, tested):
    dig, run = "symbol:lib/deep.py:Dig:1", "symbol:app/core.py:Run:1"
    met = assurance.associations(tested, targets(spark, (f("app/core.py"), "root"), (f("lib/far.py"), "downstream"), (dig, "root"), (run, "root"), (f("app/util.py"), "root"), ("gone", "root"), ("gone", "root")))
    got = {(r.target_id, r.test_path): (r.classification, r.rule) for r in met.collect()}
    assert got == {
        (f("app/core.py"), "tests/test_core.py"): ("direct", "structural_calls_imports_references"), (f("app/core.py"), "tests/test_other.py"): ("heuristic", "symbol_name_match"),
        (f("lib/far.py"), "x/far_test.py"): ("heuristic", "naming_convention"), (dig, "tests/test_other.py"): ("heuristic", "symbol_name_match"),
        (run, "tests/test_core.py"): ("heuristic", "naming_convention"), (run, "tests/test_other.py"): ("heuristic", "symbol_name_match"),
        (f("app/util.py"), None): ("unknown", "unassociated"), ("gone", None): ("unknown", "unassociated"),
    }
    one = met.where("classification = 'direct'").first()
    assert one.types == "calls, imports, references" and one.directions == "incoming_to_test, outgoing_from_test" and one.evidence.count("; ") == 2
    assert met.where("target_id = 'gone'").first().target_name == "gone"
    assert met.where(F.col("target_id") == dig).first().evidence.endswith("test_dig_fast")
    assert assurance.associations(tested, targets(spark, (f("app/core.py"), "root")), types=["inherits"]).where("classification = 'direct'").isEmpty()


def test_checklist_and_risk(spark, tested):
    roots = spark.createDataFrame([(f("app/core.py"),), (f("app/util.py"),)], "root string")
    asked = spark.createDataFrame([("app/core.py", "resolved"), ("no.py", "not_found"), (None, "invalid")], "path string, status string")
    diff = spark.createDataFrame([("modified", "app/core.py", None), ("moved", "b.py", "a.py"), ("ambiguous", "c.py", None)], "change string, path string, old_path string")
    rules = [{"source": "lib", "target": "app", "policy": "deny", "rule_id": "up"}]
    out = assurance.assess(tested, roots, asked=asked, diff=diff, rules=rules, freshness="indeterminate")
    items = {r.item_id: r for r in out["checklist"].collect()}
    assert set(items) == {
        "structural:tests/test_core.py", "heuristic:tests/test_other.py", "heuristic:x/far_test.py", "missing_test:util.py", "consolidated_test_run", "unresolved_path:no.py", "unresolved_path:", "indeterminate_freshness", "unassociated_targets",
    }
    assert items["consolidated_test_run"].command == "pytest tests/test_core.py tests/test_other.py x/far_test.py" and items["structural:tests/test_core.py"].command == "pytest tests/test_core.py"
    assert items["unassociated_targets"].targets == ["util.py"] and [r["rank"] for r in sorted(items.values(), key=lambda r: r["rank"])] == [1, 2, 2, 3, 3, 4, 4, 4, 4]
    facts = {r.fact_id: r for r in out["facts"].collect()}
    assert {"root:file:app/core.py", "root:file:app/util.py", "direct_impact:file:lib/deep.py", "downstream:file:lib/far.py", "path:file:lib/far.py", "test_structural:structural:tests/test_core.py", "unassociated_target:util.py", "comparison:moved_file:b.py", "unresolved_input:no.py"} <= set(facts)
    assert "comparison:ambiguous_file:c.py" not in facts and facts["path:file:lib/far.py"].statement.count("=>") == 1
    crossing = facts["pkg_boundary:lib->app:lib/deep.py->app/core.py"]
    assert (crossing.policy, crossing.rule_id) == ("deny", "up")
    concerns = [(r.severity, r.concern_id, r.n) for r in out["concerns"].orderBy("severity_rank", "category", "concern_id").collect()]
    assert concerns == [("error", "policy_violation:up", 1), ("error", "unresolved_inputs_risk", 2), ("warning", "unverified_affected_components", 1), ("info", "broad_downstream_impact", 1), ("info", "cross_package_propagation", 1)]
    assert {r.item_id for r in out["missing_evidence"].collect()} == {"missing_test_associations", "freshness_uncertainty", "unresolved_input:no.py", "unresolved_input:"}
    summary = out["summary"].first()
    assert (summary.direct, summary.downstream, summary.untested, summary.crossings, summary.unresolved, summary.tests) == (2, 1, 1, 1, 2, 3)


def test_lists_are_cut_with_their_number(spark):
    names = [f"m{i:03d}" for i in range(30)]
    g = graph(spark, [f"src/{n}.py" for n in names] + [f"tests/test_{n}.py" for n in names], edges=[(f("tests/test_m000.py"), f(f"src/{n}.py"), "imports", 1, 1.0) for n in names])
    met = assurance.associations(g, g.files.where("path like 'src/%'").select(F.col("id").alias("target_id"), F.lit("root").alias("target_kind")))
    items = {r.item_id: r for r in assurance.checklist(met, limit=4).collect()}
    one = items["structural:tests/test_m000.py"]
    assert (one.n_targets, one.targets) == (30, ["m000.py", "m001.py", "m002.py", "m003.py"]) and items["consolidated_test_run"].command is None and items["consolidated_test_run"].n_targets == 30
    found = spark.range(25).select(F.lit("affected_component").alias("category"), F.lit("downstream").alias("kind"), F.format_string("d:%02d", "id").alias("fact_id"), F.lit("n").alias("name"), F.col("id").cast("string").alias("statement"), F.lit(None).cast("string").alias("policy"), F.lit(None).cast("string").alias("rule_id"))
    one = assurance.concerns(found).first()
    assert (one.severity, one.n, len(one.facts), one.evidence) == ("warning", 25, 10, ["0", "1", "2", "3", "4"])
    assert assurance.concerns(found.where("false")).isEmpty() and assurance.missing_evidence(found).isEmpty()


def test_nothing_changed(spark, tested):
    none = spark.createDataFrame([], "root string")
    out = assurance.assess(tested, none)
    assert out["checklist"].isEmpty() and out["concerns"].isEmpty() and {r.kind for r in out["facts"].collect()} == {"freshness", "complete"}
    assert traverse.change_impact(tested, none).isEmpty()


def test_unused_listing(spark):
    g = graph(spark, ["m.py", "tests/test_m.py", "cli.py"], [("m.py", "a", "function", 9, 9), ("m.py", "b", "class", 2, 3), ("m.py", "__len__", "method", 4, 5), ("m.py", "__len__", "function", 6, 6), ("tests/test_m.py", "helper", "function", 1, 1), ("tests/test_m.py", "TestA", "class", 2, 2), ("cli.py", "main", "function", 1, 1)])
    got = {(r.name, r.kind): r.classification for r in usage.unused(g).collect()}
    assert got[("helper", "function")] == "unused_candidate" and got[("TestA", "class")] == got[("main", "function")] == "cannot_assess" and got[("a", "function")] == "unused_candidate"
    assert got[("m.py", "file")] == "unused_candidate" and got[("test_m.py", "file")] == "cannot_assess"
    assert {r.kind for r in usage.unused(g, "Classes").collect()} == {"class"} and {r.kind for r in usage.unused(g, "file").collect()} == {"file"} and "file" not in {r.kind for r in usage.unused(g, "symbols").collect()}
    with pytest.raises(ValueError, match="unknown kind"):
        usage.unused(g, "module")
    rows = usage.listed(usage.unused(g), 2).collect()
    assert sorted((r.classification, r.position) for r in rows) == [("cannot_assess", 1), ("cannot_assess", 2), ("unused_candidate", 1), ("unused_candidate", 2)]
    assert {r.total for r in rows if r.classification == "unused_candidate"} == {sum(c == "unused_candidate" for c in got.values())}


def test_task_states_and_relevance(spark):
    got = {r.task: (r.state, r.reasons) for r in tasks.understand(spark.createDataFrame([("fix a.py", None), ("", None), ("?", None), ("UserService", "two of them")], "task string, ambiguity string")).collect()}
    assert got["fix a.py"] == ("clear", []) and got[""] == ("insufficient", list(tasks.REASONS)) and got["?"] == ("clear", list(tasks.REASONS[2:])) and got["UserService"] == ("ambiguous", [tasks.REASONS[3], "two of them"])
    assert tasks.understand(spark.createDataFrame([(None,)], "task string")).first().state == "insufficient"
    g = graph(spark, ["src/user.py", "src/auth.py"], [("src/auth.py", "login", "function", 1, 2, "Auth.login"), ("src/auth.py", "userless", "function", 3, 4, None)])
    told = spark.createDataFrame([("t", "AUTH", ["User", "login", " ", "none"]), ("e", None, []), ("q", " auth.LOGIN ", None)], "task string, target string, concepts array<string>")
    ids = {"user": f("src/user.py"), "auth": f("src/auth.py"), "login": "symbol:src/auth.py:login:1", "userless": "symbol:src/auth.py:userless:3"}
    asked = spark.createDataFrame([(t, i) for t in "teq" for i in ids.values()], "task string, entity_id string")
    got = {(r.task, r.entity_id): round(r.relevance, 6) for r in search.relevance(g, asked.union(asked), told).collect()}
    assert len(got) == 12 and got["t", ids["auth"]] == 1.0 and got["t", ids["user"]] == round(1 / 3, 6) and got["t", ids["login"]] == round(2 / 3, 6) and got["t", ids["userless"]] == round(1 / 3, 6)
    assert {v for (t, _), v in got.items() if t == "e"} == {0.0} and got["q", ids["login"]] == 1.0 and got["q", ids["auth"]] == 0.0
    # Without the target, a file's concepts are found in the names of its symbols too.
    other = told.withColumn("target", F.lit("zzz"))
    assert {r.entity_id: round(r.relevance, 6) for r in search.relevance(g, asked.where("task = 't'"), other).collect()}[ids["auth"]] == round(2 / 3, 6)


def test_memory_symbols(spark):
    g = graph(spark, ["pkg/m.py", "pkg/n.py"], [("pkg/m.py", "Go", "function", 5, 6, "C.Go"), ("pkg/n.py", "Go", "import", 1, 1, "pkg.m.Go"), ("pkg/n.py", "Go", "function", 3, 4, "Go"), ("pkg/m.py", "os", "import", 1, 1, "os")])
    names = lambda *a, **k: [(r.path, r.start_line) for r in lookup.memory_symbols(g, *a, **k).orderBy("position").collect()]
    assert names("Go") == [("pkg/m.py", 5), ("pkg/n.py", 3)] and names("C.Go") == [("pkg/m.py", 5)] and names("pkg.n.Go") == [("pkg/n.py", 3)]
    # A qualified name that only an import has gives way to the module's own symbol, else it stays.
    assert names("pkg.m.Go") == [("pkg/n.py", 1)] and names("pkg.m.C.Go") == [("pkg/m.py", 5)] and names("os") == [("pkg/m.py", 1)]
    assert names("Go", file_path="n.py") == [("pkg/n.py", 3)] and names("Go", kind="import") == [("pkg/n.py", 1)] and names("Go", file_path="./pkg/m.py") == [("pkg/m.py", 5)] and names("no.such") == []


def test_selection_and_states(spark):
    rows = lambda *members: spark.createDataFrame([("a", m) for m in members], "case string, member string")
    assert tuple(metrics.selection_counts(rows("x", "y"), rows("x", "x", "z"), rows("x", "y"), ["case"]).first()) == ("a", 2, 1, 1)
    schema = ", ".join(f"{s}_repository string, {s}_status string, {s}_errors int, {s}_freshness string, {s}_historical boolean" for s in ("before", "after"))
    good = ("r", "analyzed", 0, "current", False)
    cases = [(None, None, None, None, None) + good, good + ("q", "analyzed", 0, None, None), good + ("r", "analyzed", 2, "stale", False), ("r", "completed", None, "stale", True) + good, ("r", "analyzed", 0, "stale", None) + good, (None, "analyzed", 0, None, None) + good]
    got = [(r.outcome, [c.code for c in r.codes]) for r in changes.validate_pairs(spark.createDataFrame(cases, schema)).collect()]
    assert got == [("blocked", ["MISSING_BEFORE_STATE"]), ("blocked", ["REPOSITORY_MISMATCH"]), ("incomplete", ["INCOMPLETE_AFTER_STATE", "STALE_STATE"]), ("success", []), ("partial", ["STALE_STATE"]), ("success", [])]


def test_preflight_ladder(spark, tmp_path):
    make = lambda *paths: (lambda: (spark.createDataFrame([("d",)], "path string"), spark.createDataFrame([(p,) for p in paths], "path string")))
    codes = lambda found: [d["code"] for d in found["diagnostics"]]
    file = tmp_path / "f"
    file.write_text("")
    assert codes(reports.preflight(str(tmp_path / "none"))) == ["REPOSITORY_NOT_FOUND"] and codes(reports.preflight(str(file))) == ["REPOSITORY_NOT_A_DIRECTORY"]
    found = reports.preflight(str(tmp_path), make("a.py", "b.js", "c.txt"))
    assert codes(found) == ["UNSUPPORTED_LANGUAGE"] and found["readiness"] == "ready_with_limitations" and found["inventory"] == {"directories": 1, "files": 3, "source_files": 2}
    assert codes(reports.preflight(str(tmp_path), make("b.js"))) == ["UNSUPPORTED_LANGUAGE", "NO_SUPPORTED_SOURCES"] and codes(reports.preflight(str(tmp_path), make())) == ["EMPTY_REPOSITORY"]
    file.write_text("= broken")
    found = reports.preflight(str(tmp_path), make("a.py"), str(file))
    assert found["readiness"] == "blocked" and codes(found) == ["CONFIG_LOAD_ERROR"] and not found["ready"]

    def broken():
        raise OSError("no disk")

    assert codes(reports.preflight(str(tmp_path), broken)) == ["SCAN_ERROR"]
    (tmp_path / ".git").mkdir()
    assert reports.preflight(str(tmp_path), make("a.py"), analysed=True)["readiness"] == "ready"


def test_operational_log(tmp_path):
    folder = str(tmp_path / "logs")
    with runs.operational_log(folder, "p") as counts:
        counts["files"] = 3
    with pytest.raises(ValueError), runs.operational_log(folder, "p"):
        raise ValueError("bad")
    lines = open(os.path.join(folder, "graphloom.log"), encoding="utf-8").read().splitlines()
    assert [line.split()[2] for line in lines] == ["analysis_started", "analysis_completed", "analysis_started", "analysis_failed"] and lines[1].endswith("files=3") and "error_type=ValueError" in lines[3]
    blocked = tmp_path / "file"
    blocked.write_text("")
    with runs.operational_log(str(blocked), "p"), runs.operational_log(None, "p"):
        pass
