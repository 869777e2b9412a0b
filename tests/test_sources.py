"""Parsing, trees, snapshots, version control, configuration, streams."""

import subprocess

import pytest
from graphloom.operators import changes, history
from graphloom.schema import Graph
from graphloom.sources import config, parse, snapshot, tree, vcs
from graphloom.streaming import history as runs
from graphloom.streaming import incremental

SOURCE = '''import a.b as c
from ..m import x as y, z
K = 1
n: int = 2
p, q = 1, 2

class A(Base, pkg.Other, Generic[T]):
    v = 1
    def go(self, a: int, b=2, *rest, k, o: str = "s", **kw) -> int:
        def inner(): pass
        return self.v + c.d.e

async def run(): return K
'''


def test_python_rows():
    out = parse.parse_python("src/f.py", SOURCE)
    got = [(s["name"], s["kind"], s["qualified_name"], s["start_line"]) for s in out.symbols]
    assert got == [("c", "import", "a.b", 1), ("y", "import", "..m.x", 2), ("z", "import", "..m.z", 2), ("K", "constant", "K", 3), ("n", "variable", "n", 4), ("A", "class", "A", 7), ("v", "variable", "A.v", 8), ("go", "method", "A.go", 9), ("inner", "function", "A.go.inner", 10), ("run", "function", "run", 13)]
    assert out.symbols[7]["signature"] == "go(self, a: int, b = 2, *rest, k, o: str = 's', **kw)"
    assert [(i["module_name"], i["imported_name"], i["alias"], i["level"]) for i in out.imports] == [("a.b", None, "c", 0), ("..m", "x", "y", 2), ("..m", "z", None, 2)]
    assert [(b["name"], b["qualified_name"]) for b in out.inheritance] == [("Base", "Base"), ("Other", "pkg.Other")]
    assert {(r["name"], r["qualified_name"]) for r in out.references} >= {("e", "c.d.e"), ("d", "c.d"), ("c", None), ("K", None), ("v", "self.v")}
    near = parse.parse_python("p/f.py", "from . import m, n as o\nfrom .. import q\n")
    assert [(x["name"], x["qualified_name"]) for x in near.symbols] == [("m", "..m"), ("o", "..n"), ("q", "...q")]
    assert [(i["module_name"], i["imported_name"], i["level"]) for i in near.imports] == [(".", "m", 1), (".", "n", 1), ("..", "q", 2)]
    bad = parse.parse_python("b.py", "def (")
    assert bad.errors[0].startswith("b.py:1:") and not bad.symbols
    with pytest.raises(ValueError):
        parse.Registry().register("python", parse.parse_python)


def write(root, files):
    for path, text in files.items():
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(text)


TREE = {"src/pkg/__init__.py": "from .m import A\n", "src/pkg/m.py": "class A:\n    def go(self):\n        return 1\n", "src/n.py": "from pkg.m import A\nclass B(A):\n    pass\nprint(A().go())\n", "bad.py": "def (\n", "app.js": "x", ".git/x.py": "x = 1", "_hidden.py": "h = 1\n", "latin.py": "é = 'é'\n"}


def rows(graph):
    return {name: sorted(map(str, df.select(sorted(df.columns)).collect())) for name in snapshot.TABLES if (df := getattr(graph, name)) is not None}


def test_tree_to_graph(spark, tmp_path):
    write(tmp_path, TREE)
    g = tree.analyse(spark, str(tmp_path))
    assert {r.path for r in g.files.collect()} == set(TREE) - {".git/x.py"}
    assert {r.path: r.depth for r in g.directories.collect()} == {".": 0, "src": 1, "src/pkg": 2}
    errors = sorted(r.message for r in g.errors.collect())
    assert errors[0].startswith("No parser available for javascript") and errors[1].startswith("bad.py:1:")
    kinds = {(r.source_id, r.relationship_type) for r in g.edges.collect()}
    assert ("file:src/n.py", "imports") in kinds and ("symbol:src/n.py:class:B:2:0", "inherits") in kinds
    prints = tree.fingerprints(tree.contents(spark, str(tmp_path), g.files))
    assert prints.count() == len(TREE) - 1


def test_snapshot_round_trip(spark, tmp_path):
    write(tmp_path / "t", TREE)
    store = str(tmp_path / "store")
    assert snapshot.load(spark, store) is None
    g = tree.analyse(spark, str(tmp_path / "t"))
    snapshot.save(spark, g, store, tree.fingerprints(tree.contents(spark, str(tmp_path / "t"), g.files)))
    assert rows(snapshot.load(spark, store)) == rows(g)
    first = snapshot.load_fingerprints(spark, store)
    (tmp_path / "t/src/n.py").write_text("x = 1\n")
    (tmp_path / "t/new.py").write_text("y = 1\n")
    _, files = tree.scan(spark, str(tmp_path / "t"))
    found = {r.path: r.change for r in changes.file_changes(first, tree.fingerprints(tree.contents(spark, str(tmp_path / "t"), files))).where("change <> 'unchanged'").collect()}
    assert found == {"src/n.py": "modified", "new.py": "added"}
    assert snapshot.invalidate(spark, store) and snapshot.load(spark, store) is None


def test_incremental_is_a_full_rebuild(spark, tmp_path):
    write(tmp_path, TREE)
    old = tree.analyse(spark, str(tmp_path))
    edits = {"src/pkg/m.py": "class A:\n    def stop(self):\n        return 2\n", "src/extra.py": "from n import B\nB()\n", "bad.py": "ok = 1\n"}
    versions = [(p, t, "2024-01-02 00:00:00") for p, t in edits.items()] + [("src/n.py", "class B:\n    pass\n", "2024-01-01 00:00:00"), ("src/n.py", None, "2024-01-03 00:00:00")]
    df = spark.createDataFrame(versions, "path string, content string, at string").withColumn("at", __import__("pyspark").sql.functions.to_timestamp("at"))
    got = rows(incremental.apply_versions(old, df))
    write(tmp_path, edits)
    (tmp_path / "src/n.py").unlink()
    want = rows(tree.analyse(spark, str(tmp_path)))
    for name in ("files", "symbols", "imports", "references", "inheritance", "errors", "edges"):
        assert got[name] == want[name], name
    merged = changes.merge(old, old, spark.createDataFrame([("src/n.py",)], "path string"))
    assert merged.symbols.count() >= old.symbols.count()


def test_refresh_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "path string, content string, at timestamp"
    empty_rows = tree.analyse(spark, str((tmp_path / "none").mkdir() or tmp_path / "none"))
    put = lambda r: spark.createDataFrame(r, "path string, content string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(source)
    empty = lambda: Graph(*(getattr(empty_rows, n) for n in snapshot.TABLES))
    put([("a.py", "import b\n", "2024-01-01 00:00:00"), ("b.py", "x = 1\n", "2024-01-01 00:00:00")])
    for _ in range(2):
        incremental.refresh_stream(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "c"), empty).awaitTermination()
    assert snapshot.load(spark, store).edges.where("relationship_type = 'imports'").count() == 1
    put([("b.py", None, "2024-01-02 00:00:00")])
    incremental.refresh_stream(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "c"), empty).awaitTermination()
    g = snapshot.load(spark, store)
    assert [r.path for r in g.files.collect()] == ["a.py"] and g.edges.where("relationship_type = 'imports'").count() == 0


def test_activity_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    runs.activity(stream, delay="60 days").writeStream.outputMode("update").format("memory").queryName("activity_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    key = lambda r: (r.window_start, r.event_type)
    last = {key(r): r.events for r in spark.table("activity_out").orderBy("events").collect()}
    assert last == {key(r): r.events for r in runs.activity(events).collect()}


def test_runs_stream_keeps_unfinished_ones(spark):
    from pyspark.sql import functions as F

    rows_ = [("r1", "analyse", "2024-01-01 00:00:00", "start", None), ("r1", None, "2024-01-01 01:00:00", "finish", "success"), ("r2", "analyse", "2024-01-01 00:00:00", "start", None)]
    df = spark.createDataFrame(rows_, "id string, command string, at string, event string, outcome string").withColumn("at", F.to_timestamp("at"))
    assert {r.id: r.outcome for r in runs.finished_runs(df).collect()} == {"r1": "success", "r2": "incomplete"}


def test_version_control(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    assert not vcs.is_repository(str(tmp_path))
    git("init", "-q", "-b", "main")
    assert vcs.info(str(tmp_path))["head"] is None
    write(tmp_path, {"a.py": "x\n", "b c.py": "y\ny\n"})
    git("add", "-A")
    git("commit", "-qm", "first | change")
    write(tmp_path, {"a.py": "x\nz\n"})
    git("commit", "-qam", "second")
    git("mv", "b c.py", "d.py")
    write(tmp_path, {"new.py": ""})
    found = vcs.commits(spark, str(tmp_path))
    assert {r.message: len(r.changes) for r in found.collect()} == {"first | change": 2, "second": 1}
    assert {(r.path, r.additions) for r in vcs.changes(found).collect()} == {("a.py", 1), ("b c.py", 2)}
    status = {r.path: r for r in vcs.status(spark, str(tmp_path)).collect()}
    assert status["d.py"].orig_path == "b c.py" and status["d.py"].is_renamed and status["new.py"].is_untracked
    assert vcs.info(str(tmp_path))["branch"] == "main" and vcs.is_repository(str(tmp_path))
    for bad in ("X", "M  a\0Rxy", "R  new\0"):
        with pytest.raises(ValueError):
            vcs.parse_status(bad)


def test_commit_log_by_ranges_and_by_stream(spark, tmp_path):
    """Partitions of two commits, renames with both names and their own counts, a merge, odd names, a limit; a stream takes each commit once."""
    repo, out = tmp_path / "r", str(tmp_path / "out")
    repo.mkdir()
    tick = iter(range(1, 100))

    def git(*a):
        at = f"2024-01-01T00:00:{next(tick):02d}+02:00"
        return subprocess.run(["git", "-C", str(repo), "-c", "user.name=Ä b", "-c", "user.email=a@b", *a], check=True, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at}).stdout

    git("init", "-q", "-b", "main")
    assert vcs.commits(spark, str(repo)).count() == 0

    def streamed():
        spark.dataSource.register(vcs.CommitLog)
        spark.readStream.format("commit_log").option("commits_per_partition", 2).load(str(repo)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination(90)
        return sorted((r.ordinal, r.message) for r in spark.read.schema(vcs.COMMITS).parquet(out).collect())

    def commit(text, files):
        write(repo, files)
        git("add", "-A")
        git("commit", "-qm", text)

    commit("one", {"a.py": "1\n2\n3\n4\n5\n6\n", "é \t.py": "x\n"})
    commit("two", {"a.py": "1\n2\n3\n4\n5\n6\n7\n"})
    git("mv", "a.py", "b.py")
    commit("three", {"b.py": "1\n2\n3\n4\n5\n6\n7\n8\n"})
    first = streamed()
    git("checkout", "-qb", "side", "HEAD~1")
    commit("side", {"s.py": "s\n"})
    git("checkout", "-q", "main")
    commit("four", {"c.py": "c\n"})
    git("merge", "-qm", "merge", "side")
    git("rm", "-q", "c.py")
    commit("gone", {})
    found = {r.message: r for r in vcs.commits(spark, str(repo), commits_per_partition=2).collect()}
    changed = lambda m: {(c.path, c.old_path, c.status, c.additions, c.deletions) for c in found[m].changes}
    assert changed("one") == {("a.py", None, "A", 6, 0), ("é \t.py", None, "A", 1, 0)} and changed("two") == {("a.py", None, "M", 1, 0)}
    assert changed("three") == {("b.py", "a.py", "R", 1, 0)} and changed("merge") == set() and len(found["merge"].parents) == 2 and changed("gone") == {("c.py", None, "D", 0, 1)}
    assert sorted(r.ordinal for r in found.values()) == list(range(7)) and found["one"].ordinal == 0 and found["gone"].ordinal == 6 and found["one"].author == "Ä b"
    assert [r.message for r in vcs.commits(spark, str(repo), limit=1).collect()] == ["gone"]
    assert vcs.commits(spark, str(repo), commits_per_partition=2).rdd.getNumPartitions() == 4
    after = streamed()
    assert [m for _, m in first] == ["one", "two", "three"] and after[:3] == first and sorted(o for o, _ in after) == list(range(7)) and {m for _, m in after} == set(found)
    with pytest.raises(Exception, match="limit must be positive"):
        vcs.commits(spark, str(repo), limit=0).count()


def test_paths_today(spark):
    """Chains of renames, a name used again, a deletion and a new file of the same name."""
    events = [(0, "a", None, "A"), (1, "a", None, "M"), (2, "b", "a", "R"), (3, "a", None, "A"), (4, "c", "b", "R"), (5, "a", None, "D"), (6, "a", None, "A"), (7, "d", "a", "R"), (8, "c", None, "M"), (9, "d", "c", "C"), (10, "e", None, "A"), (11, "e", None, "D")]
    got = {(r.ordinal, r.path): r.current_path for r in history.paths_today(spark.createDataFrame(events, "ordinal long, path string, old_path string, status string")).collect()}
    assert got == {(0, "a"): "c", (1, "a"): "c", (2, "b"): "c", (3, "a"): None, (4, "c"): "c", (5, "a"): None, (6, "a"): "d", (7, "d"): "d", (8, "c"): "c", (9, "d"): "d", (10, "e"): None, (11, "e"): None}
    long = [(i, f"p{i}", f"p{i - 1}" if i else None, "R" if i else "A") for i in range(300)]
    assert {r.current_path for r in history.paths_today(spark.createDataFrame(long, "ordinal long, path string, old_path string, status string")).collect()} == {"p299"}


def test_mapped_paths_and_roots(spark):
    files = spark.createDataFrame([("f1", "src/a.py"), ("f2", "./twice"), ("f3", "old.py")], "id string, path string")
    directories = spark.createDataFrame([("d1", "src"), ("d2", "twice")], "id string, path string")
    status = spark.createDataFrame([("p/src/a.py", None), ("p/src/", None), ("p/twice", None), ("./p/new.py", "p/old.py"), ("p", None), ("q/x", None), ("/abs", None), ("C:/x", None), ("p/../x", None), ("p\\src\\a.py", "q/gone.py")], "path string, orig_path string")
    got = {r.path: (r.match, r.entity_id, r.candidates, r.reason, r.orig_match, r.orig_entity_id) for r in history.map_paths(status, files, directories, "/r", "/r/p/").collect()}
    assert got == {
        "p/src/a.py": ("matched", "f1", 1, None, None, None), "p/src/": ("matched", "d1", 1, None, None, None), "p/twice": ("ambiguous", None, 2, None, None, None), "./p/new.py": ("unmatched", None, 0, "no_entity", "matched", "f3"),
        "p": ("unmatched", None, 0, "no_entity", None, None), "q/x": ("unmatched", None, 0, "outside_root", None, None), "/abs": ("unmatched", None, 0, "escapes_root", None, None), "C:/x": ("unmatched", None, 0, "escapes_root", None, None),
        "p/../x": ("unmatched", None, 0, "escapes_root", None, None), "p\\src\\a.py": ("matched", "f1", 1, None, None, None),
    }
    far = history.map_paths(status, files, directories, "/r", "/other")
    assert {r.match for r in far.collect()} == {"unavailable"} and history.mapping_counts(far).first().outcome == "blocked"
    assert history.mapping_counts(history.map_paths(status.where("path = 'p/src/'"), files, directories, "/r", "/r/p")).first().asDict() == {"total": 1, "matched": 1, "unmatched": 0, "ambiguous": 0, "unavailable": 0, "outcome": "success"}


def test_listing_is_what_a_walk_finds(spark, tmp_path):
    import os

    files = {f"d{i}/e{j}/f{k}.py": "x" for i in range(3) for j in range(2) for k in range(2)} | {"__pycache__/c.py": "x", "d0/.git/h": "x", "_x/.y": "z", "top.md": "t", "skip.db": "s"}
    write(tmp_path, files)
    (tmp_path / "link.py").symlink_to(tmp_path / "top.md")
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "empty").mkdir()
    want = {(".", True, 0)}
    for top, dirs, names in os.walk(tmp_path):
        dirs[:] = [d for d in dirs if d not in tree.classify.IGNORED_DIRECTORIES and not os.path.islink(os.path.join(top, d))]
        at = lambda n, top=top: os.path.relpath(os.path.join(top, n), tmp_path)
        want |= {(at(d), True, 0) for d in dirs} | {(at(n), False, os.path.getsize(os.path.join(top, n))) for n in names if n != "skip.db" and not os.path.islink(os.path.join(top, n))}
    got = [(r.path, r.is_directory, r.size) for r in tree.listing(spark, str(tmp_path), ("skip.db",)).collect()]
    assert set(got) == want and len(got) == len(want) and ("_x/.y", False, 1) in want
    assert tree.listing(spark, str(tmp_path / "none")).collect()[0].path == "."
    assert {r.path for r in tree.current_fingerprints(spark, str(tmp_path), ("skip.db",)).collect()} == {p for p, is_dir, _ in want if not is_dir}


def test_configuration(tmp_path):
    (tmp_path / "c.toml").write_text('impact_depth = 2\n[packages]\ndefault_policy = "deny"\ndeny = ["a -> b"]\n[[rules]]\nkind = "isolated_component"\nsource = "db"\n')
    found = config.validate(config.load(str(tmp_path / "c.toml")))
    assert found["package_policy"]["rules"][0]["rule_id"] == "a->b" and found["rules"][0]["severity"] == "error"
    assert config.resolve({"impact_depth": 2}, {"impact_depth": 9, "report_limit": 7})["impact_depth"] == (2, "project")
    assert config.resolve()["context_budget"] == (20, "default") and config.load(str(tmp_path / "no.toml")) == {}
    with pytest.raises(config.ConfigurationError, match="say the same"):
        config.validate({"packages": {}, "boundaries": {}})
    with pytest.raises(config.ConfigurationError, match="needs a target"):
        config.validate({"rules": [{"kind": "layer_boundary", "source": "a"}]})


def test_source_evidence_and_its_guard(spark, tmp_path):
    from graphloom.operators import lookup

    root = tmp_path / "r"
    write(root, {"a.py": "import os\n@d\ndef go():\n    return 1\n\nX = 2\n", "dir/b.py": "class B:\r\n    pass\r\n"})
    write(tmp_path, {"secret.py": "class S: pass\n"})
    (root / "link.py").symlink_to(tmp_path / "secret.py")
    (root / "bytes.py").write_bytes(b"class \xff:\n    pass\n")
    rows = [
        ("go", "function", "a.py", 2, 4), ("go", "function", "a.py", 6, 6), ("go", "function", "a.py", 9, 9), ("go", "function", "a.py", None, 3), ("go", "function", "a.py", 4, 2), ("X", "constant", "a.py", 6, 60), ("B", "class", "dir/b.py", 1, 2),
        ("S", "class", "link.py", 1, 1), ("S", "class", "../secret.py", 1, 1), ("S", "class", str(tmp_path / "secret.py"), 1, 1), ("D", "class", "dir", 1, 1), ("N", "class", "none.py", 1, 1), ("N", "class", None, 1, 1), ("N", "class", "bad\0name.py", 1, 1), ("u", "module", "bytes.py", 1, 2),
    ]
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, kind string, path string, start_line int, end_line int")
    read = tree.read_sources(spark, str(root), asked.where("path is not null"))
    got = [(r.status, r.excerpt, r.truncated) for r in lookup.source_evidence(asked.join(read, "path", "left"), 2).orderBy("i").collect()]
    assert [s for s, _, _ in got] == ["success", "stale_location", "location_out_of_range", "invalid_location", "invalid_location", "success", "success", "path_outside_root", "path_outside_root", "path_outside_root", "invalid_file_type", "missing_file", "missing_file", "invalid_path", "success"]
    assert got[0][1:] == ("@d\ndef go():", True) and got[5][1:] == ("X = 2", False) and got[6][1] == "class B:\n    pass" and all(e is None for s, e, _ in got if s not in ("success", "stale_location"))
    with pytest.raises(ValueError):
        lookup.source_evidence(asked, 0)


def test_configuration_audit(tmp_path):
    one, two = tmp_path / "p.toml", tmp_path / "g.toml"
    assert (found := config.audit(str(one), str(two)))["status"] == "default" and set(found["precedence"].values()) == {"default"} and not any(found["present"].values())
    one.write_text("impact_depth = 2\n")
    two.write_text("impact_depth = 9\nreport_limit = 7\n")
    found = config.audit(str(one), str(two))
    assert found["status"] == "valid" and found["precedence"] == {"context_budget": "default", "impact_depth": "project", "report_limit": "global"} and found["values"]["impact_depth"] == 2
    one.write_text("impact_depth = 0\nreport_limit = 'x'\n")
    two.write_text("= broken")
    found = config.audit(str(one), str(two))
    assert found["status"] == "invalid" and found["values"] is None and found["precedence"] == {} and [d["code"] for d in found["diagnostics"]] == ["CONFIG_VALIDATION_ERROR"] * 2 + ["CONFIG_LOAD_ERROR"]
    assert config.audit(str(tmp_path))["diagnostics"][0]["code"] == "CONFIG_NOT_A_FILE"
