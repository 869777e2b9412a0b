"""The facade, the command line and baselines, end to end on a small tree."""

import json

import pytest
from graphloom import __main__ as command
from graphloom.operators import metrics
from graphloom.project import AmbiguousTarget, Project
from graphloom.sources import baseline

from .test_sources import TREE, write


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    write(root, {**TREE, "src/other.py": "class B:\n    pass\n"})
    at = str(tmp_path_factory.mktemp("store"))
    Project.analyse(spark, str(root), at)
    return at, str(root)


def test_questions(spark, store):
    p = Project.load(spark, *store)
    assert {r.path for r in p.dependencies("src/n.py").collect()} == {"src/pkg/m.py"} or p.dependencies("src/n.py").count() <= 1
    assert p.resolve("src/n.py") == "file:src/n.py"
    with pytest.raises(AmbiguousTarget) as found:
        p.resolve("B")
    assert len(found.value.candidates) == 2
    with pytest.raises(LookupError):
        p.resolve("nothing")
    assert p.search("n.py").where("position = 1").first()["path"] == "src/n.py"
    assert p.excerpt("pkg.m.A").first()["header"] == "valid"
    assert p.path("src/n.py", "pkg.m.A")["status"] == "resolved"
    assert p.context("explain src/n.py").where("content is not null").count() >= 1
    assert p.freshness(store[0]) == "incomplete"  # one file has a syntax error
    assert {r.code for r in p.diagnostics().collect()} == {"parse_error", "no_parser"}
    assert p.violations().count() == 0 and p.unused()["files"].count() > 0
    assert p.compare(p)["symbols"].count() == p.compare(p)["edges"].count() == 0
    p.register_views()
    assert spark.sql("SELECT count(*) AS n FROM edges e JOIN vertices v ON v.id = e.source_id").first()["n"] > 0


def test_command_line(spark, store, capsys, monkeypatch):
    monkeypatch.setattr(command, "session", lambda: spark)
    assert command.main([store[0], "summary"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {r["table"] for r in rows} >= {"files", "symbols"}
    assert command.main([store[0], "impact", "src/n.py"]) == 0 and capsys.readouterr().out
    assert command.main([store[0], "impact", "B"]) == 1 and "candidates" in capsys.readouterr().err
    assert command.main([store[0] + "none", "summary"]) == 1


def test_commands_that_keep_a_store_current(spark, tmp_path, capsys, monkeypatch):
    """preflight, analyse, status, refresh, cache, history, rules, post-change and inspection on a tree that changes."""
    monkeypatch.setattr(command, "session", lambda: spark)
    root, at = tmp_path / "tree", str(tmp_path / "store")

    def run(*arguments):
        code = command.main([at, "--root", str(root), *arguments])
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith(("{", "["))]

    for path, text in {"a/__init__.py": "", "a/m.py": "class M:\n    pass\n", "b/__init__.py": "", "b/n.py": "from a.m import M\nm = M()\n", "test_n.py": "from b.n import m\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    code, rows = run("preflight", str(root))
    assert code == 0 and rows[0]["languages"]["Python"]["files"] == 5 and run("preflight", str(tmp_path / "none"))[0] == 1
    assert run("analyse", str(root))[0] == 0
    assert run("status")[1][0] | {"state": "current", "reason": "fresh"} == run("status")[1][0]
    (root / "a/m.py").write_text("class M:\n    pass\n\nclass N(M):\n    pass\n")
    (root / "c.py").write_text("from a.m import N\nN()\n")
    (root / "test_n.py").unlink()
    assert run("status")[1][0]["reason"] == "files changed (1 modified, 1 added, 1 deleted)"
    version = run("cache")[1][0]["version"]
    assert run("refresh")[0] == 0 and run("status")[1][0]["state"] == "current" and run("cache")[1][0]["version"] != version
    got = Project.load(spark, at, str(root)).graph
    whole = Project.analyse(spark, str(root)).graph
    plain = lambda df: sorted(str([sorted(v.items()) if isinstance(v, dict) else v for v in r]) for r in df.select(sorted(df.columns)).collect())
    for name in ("directories", "files", "symbols", "edges", "imports"):
        assert plain(getattr(got, name)) == plain(getattr(whole, name)), name
    rows = run("history")[1]
    assert [r["command"] for r in rows] == ["refresh", "analyse"] and {r["outcome"] for r in rows} == {"success"}
    config = tmp_path / "c.toml"
    config.write_text('[[rules]]\nkind = "prohibited_dependency"\nsource = "b"\ntarget = "a"\n[packages]\ndefault_policy = "unrestricted"\ndeny = ["b -> a"]\n')
    assert {r["outcome"] for r in run("rule_report", str(config))[1]} == {"violation"}
    project = Project.load(spark, at, str(root))
    summary = project.post_change(["a/m.py"], str(config))["summary"].first()
    assert summary.status == "partial" and summary.rule_violations == 1 and summary.policy_violations >= 1 and summary.roots == 1 and summary.freshness == "current"
    (root / "c.py").write_text("x = 1\n")
    assert {r["section"] for r in run("post_change", "a/m.py")[1]} >= {"impact", "summary"} and project.post_change(["c.py"])["summary"].first().freshness == "stale"
    sections = run("inspect_change", "a.m.M")[1]
    assert any(r["section"] == "resolution" and r["status"] == "resolved" for r in sections)
    config.write_text("= broken")
    assert run("rule_report", str(config))[0] == 1


def test_baselines(spark, tmp_path):
    scored = metrics.scores(spark.createDataFrame([("a", 2, 2, 1), ("b", 0, 0, 0)], "case string, expected long, actual long, matched long"))
    path = str(tmp_path / "b.json")
    baseline.save(scored, path)
    back = baseline.load(spark, path)
    assert [tuple(r) for r in metrics.regression(back, scored).orderBy("case").collect()] == [("a", 0.5, 0.5, 0.0, False), ("b", 1.0, 1.0, 0.0, False)]
    for text in ("x", "[]", '{"version":1,"cases":[{"case":"a"}]}', '{"version":1,"cases":[{"case":"a","precision":2,"recall":0,"f1":0}]}'):
        (tmp_path / "b.json").write_text(text)
        with pytest.raises(ValueError):
            baseline.load(spark, path)
