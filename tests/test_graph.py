"""Operators on small graphs built by hand."""

import random

import pytest
from graphloom.functions import paths, tasks
from graphloom.operators import changes, classify, history, link, lookup, metrics, search, structure, traverse, units, usage
from graphloom.plans import context, reports
from graphloom.schema import DIRECTORIES, EDGES, ERRORS, FILES, IMPORTS, REFERENCES, SYMBOLS, Graph, violations
from pyspark.sql import functions as F


def graph(spark, files, symbols=(), edges=(), imports=(), references=(), errors=()):
    """files: paths; symbols: (path, name, kind, start, end[, qualified]); edges: (source, target, type, line, confidence)."""
    dirs = sorted({"/".join(p.split("/")[:i]) for p in files for i in range(1, len(p.split("/")))})
    d = [(f"dir:{x}", x, x.split("/")[-1], f"dir:{x.rpartition('/')[0]}" if "/" in x else None, x.count("/") + 1, "source") for x in dirs]
    f = [(f"file:{p}", f"dir:{p.rpartition('/')[0]}" if "/" in p else None, p, p.split("/")[-1], "." + p.rpartition(".")[2], "source", 10, False, False) for p in files]
    s = [(f"symbol:{x[0]}:{x[1]}:{x[3]}", f"file:{x[0]}", x[1], x[2], x[5] if len(x) > 5 else x[1], x[3], x[4], None, None) for x in symbols]
    e = [(f"e{i:03d}", a, b, t, c, {} if line is None else {"line": str(line)}) for i, (a, b, t, line, c) in enumerate(edges)]
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return Graph(make(d, DIRECTORIES), make(f, FILES), make(s, SYMBOLS), make(e, EDGES), make(imports, IMPORTS), make(references, REFERENCES), make([], "file_id string, class_symbol_id string, name string, line int, col int, qualified_name string, ordinal bigint"), make(errors, ERRORS))


@pytest.fixture(scope="module")
def chain(spark):
    f = [f"src/{x}.py" for x in ("a", "b", "c", "d", "e", "isolated")]
    i = lambda x: f"file:src/{x}.py"
    return graph(spark, f, edges=[(i("a"), i("b"), "imports", 10, 1.0), (i("b"), i("c"), "calls", 25, 0.9), (i("c"), i("d"), "references", None, 0.8), (i("d"), i("e"), "depends_on", None, 0.7), (i("a"), i("c"), "references", None, 0.6)])


def ids(path):
    return f"file:src/{path}.py"


def test_paths_found_and_not(chain):
    got = traverse.find_path(chain, ids("a"), ids("e"))
    assert got["status"] == "resolved" and [s["to_id"] for s in got["path"]] == [ids("c"), ids("d"), ids("e")]
    assert traverse.find_path(chain, ids("a"), ids("a"))["path"] == []
    assert traverse.find_path(chain, ids("a"), ids("isolated"))["status"] == "no_path_found"
    assert traverse.find_path(chain, ids("a"), ids("e"), max_depth=2)["status"] == "depth_limited"
    assert traverse.find_path(chain, ids("a"), ids("e"), max_expansions=1)["status"] == "expansion_limited"
    assert traverse.find_path(chain, ids("e"), ids("a"), direction="outgoing")["status"] == "no_path_found"
    assert len(traverse.find_path(chain, ids("e"), ids("a"), direction="incoming")["path"]) == 3


def test_impact_takes_the_least_path_whatever_the_order_of_rows(spark, chain):
    roots = spark.createDataFrame([(ids("a"),)], "root string")
    want = None
    for seed in range(3):
        chain.edges = chain.edges.orderBy(F.rand(seed)).repartition(3)
        got = sorted((r.node, r.depth, r.classification, tuple(s["edge_id"] for s in r.path)) for r in traverse.impact(chain, roots, 3).collect())
        want = want or got
        assert got == want
    assert [(n, d) for n, d, *_ in want] == [(ids("b"), 1), (ids("c"), 1), (ids("d"), 2), (ids("e"), 3)]


def test_kinds_filter_what_is_listed_not_the_walk(spark):
    g = graph(spark, ["a.py", "b.py"], [("b.py", "f", "function", 1, 2)], [("file:a.py", "symbol:b.py:f:1", "references", 1, 1.0), ("symbol:b.py:f:1", "file:b.py", "calls", 1, 1.0)])
    got = traverse.impact(g, spark.createDataFrame([("file:a.py",)], "root string"), 3, kinds=("file",)).collect()
    assert [(r.node, r.depth) for r in got] == [("file:b.py", 2)]


def test_dangling_ends_are_unknown_and_loops_count_twice(spark):
    g = graph(spark, ["a.py"], edges=[("file:a.py", "gone", "calls", 1, 1.0), ("file:a.py", "file:a.py", "calls", 1, 1.0)])
    got = traverse.direct_impact(g, spark.createDataFrame([("file:a.py",)], "entity_id string")).collect()
    assert sorted((r.direction, r.kind) for r in got) == [("incoming", "file"), ("outgoing", "file"), ("outgoing", "unknown")]
    # Only edges of containment must have both ends.
    assert structure.integrity(g).count() == 0
    g = graph(spark, ["a.py"], edges=[("file:a.py", "gone", "defines", 1, 1.0), ("file:a.py", "file:a.py", "contains", 1, 1.0)])
    assert {r.finding for r in structure.integrity(g).collect()} == {"missing_relationship_endpoint", "invalid_relationship_endpoint_type"}


def test_strong_components_against_brute_force(spark):
    rng = random.Random(6)
    for _ in range(4):
        pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(20)}
        reach = {(a, b) for a, b in pairs}
        for k in range(14):
            reach |= {(a, b) for a in range(14) for b in range(14) if (a, k) in reach and (k, b) in reach}
        nodes = {x for p in pairs for x in p}
        want = {n: min([n, *(m for m in nodes if (n, m) in reach and (m, n) in reach)]) for n in nodes}
        got = {r.node: r.component for r in traverse.components(spark.createDataFrame(list(pairs), "src long, dst long")).collect()}
        assert got == want
    # Chains between dense parts, chains within a cycle, rings, and loops.
    pairs = [(0, 1), (1, 0), (1, 20), (20, 21), (21, 22), (22, 5), (5, 6), (6, 7), (7, 30), (30, 31), (31, 5), (6, 5), (40, 41), (41, 42), (42, 40), (50, 50), (5, 60), (60, 61), (7, 7)]
    got = {r.node: r.component for r in traverse.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    groups = {n: n for p in pairs for n in p} | dict.fromkeys((0, 1), 0) | dict.fromkeys((5, 6, 7, 30, 31), 5) | dict.fromkeys((40, 41, 42), 40)
    assert got == groups
    loop = traverse.cycles(spark.createDataFrame([(1, 1), (2, 3)], "src long, dst long")).collect()
    assert [(r.component, r.size, r.internal_edges) for r in loop] == [(1, 1, 1)]


def test_long_chains_and_rings_take_few_rounds(spark):
    """Ten thousand modules in a row, in a ring, and in a ring with a shortcut, numbered at random."""
    order = list(range(10_000))
    random.Random(3).shuffle(order)
    row = list(zip(order[:-1], order[1:], strict=True))
    for pairs, size in ((row, 1), ([*row, (order[-1], order[0])], 10_000), ([*row, (order[-1], order[0]), (order[10], order[5000])], 10_000)):
        rounds = []
        got = traverse.components(spark.createDataFrame(pairs, "src long, dst long").repartition(4), rounds)
        assert got.groupBy("component").count().agg({"count": "max", "component": "min"}).first()[0:2] in ((size, 0), (0, size))
        assert len(rounds) < 40, len(rounds)


def test_resolution_of_targets(spark):
    g = graph(spark, ["src/pkg/__init__.py", "src/pkg/m.py", "src/n.py"], [("src/pkg/m.py", "Config", "class", 1, 5), ("src/n.py", "Config", "class", 1, 5), ("src/n.py", "os", "import", 1, 1), ("src/n.py", "run", "function", 7, 9)])
    want = {"src/n.py": "resolved", "./src/n.py": "resolved", "Config": "ambiguous", "pkg.m.Config": "resolved", "pkg.m": "resolved", "pkg": "resolved", "run": "resolved", "os": "not_found", "n.run": "resolved", "zzz": "not_found"}
    got = lookup.resolve_targets(g, spark.createDataFrame([(t,) for t in want], "target string"))
    assert {r.target: r.status for r in got.collect()} == want
    assert lookup.locate_symbols(g, "os").count() == 1 and lookup.locate_symbols(g, "Config", file_path="n.py").count() == 1


def test_linking_ladder_and_its_traps(spark):
    symbols = [("src/pkg/m.py", "f", "function", 1, 2), ("src/a.py", "f", "function", 1, 2), ("src/a.py", "g", "function", 3, 4), ("src/b.py", "f", "import", 1, 1, "pkg.m.f"), ("src/pkg/m.py", "only", "function", 5, 6)]
    imports = [("file:src/b.py", "a", "f", None, 0, 1), ("file:src/b.py", "pkg", None, None, 0, 2), ("file:src/pkg/m.py", ".", "z", None, 1, 3), ("file:src/pkg/m.py", "..", "a", None, 2, 4), ("file:src/pkg/m.py", "...", "a", None, 3, 5), ("file:src/b.py", "a", "g", None, 0, 6)]
    refs = [("file:src/b.py", "g", 9, 0, None, "reference", 1), ("file:src/b.py", "g", 3, 0, None, "reference", 2), ("file:src/a.py", "f", 5, 0, None, "reference", 3), ("file:src/a.py", "only", 6, 0, None, "reference", 4), ("file:src/b.py", "f", 7, 0, None, "reference", 5)]
    g = graph(spark, ["src/pkg/__init__.py", "src/pkg/m.py", "src/a.py", "src/b.py", "src/pkg/z.py"], symbols, imports=imports, references=refs)
    found = {(r.file_id, r.ordinal): r.target_id for r in link.resolve_imports(g.files, g.imports).collect()}
    # A package's own file keeps ``src`` in its module name, so ``import pkg`` stays unresolved.
    assert found == {("file:src/b.py", 1): "file:src/a.py", ("file:src/b.py", 2): None, ("file:src/pkg/m.py", 3): "file:src/pkg/z.py", ("file:src/pkg/m.py", 4): None, ("file:src/pkg/m.py", 5): None, ("file:src/b.py", 6): "file:src/a.py"}
    edges = {(r.source_id, r.target_id): (r.confidence, r.metadata["line"]) for r in link.reference_edges(g.symbols, g.references, g.imports).collect()}
    assert edges[("file:src/b.py", "symbol:src/a.py:g:3")] == (0.9, "3")  # the first line stays
    assert edges[("file:src/a.py", "symbol:src/a.py:f:1")] == (0.8, "5")
    assert edges[("file:src/a.py", "symbol:src/pkg/m.py:only:5")] == (0.7, "6")
    assert len(edges) == 3  # two functions f may be meant in b: dropped


def test_unused_ladder(spark):
    symbols = [("m.py", n, "function", i * 10 + 1, i * 10 + 5) for i, n in enumerate(("used", "recursive", "noline", "lonely", "__init__", "byname"))] + [("m.py", "twin", "function", 101, 105), ("m.py", "twin", "function", 111, 115), ("tests/test_m.py", "test_x", "function", 1, 2), ("bad.py", "b", "function", 1, 2)]
    s = lambda n, i: f"symbol:m.py:{n}:{i * 10 + 1}"
    edges = [("file:o.py", s("used", 0), "references", 1, 1.0), ("file:m.py", s("recursive", 1), "references", 13, 1.0), ("file:m.py", s("noline", 2), "references", None, 1.0), ("file:o.py", s("lonely", 3), "imports", 1, 1.0)]
    refs = [("file:m.py", "byname", 99, 0, None, "reference", 1), ("file:m.py", "twin", 99, 0, None, "reference", 2)]
    g = graph(spark, ["m.py", "o.py", "tests/test_m.py", "bad.py"], symbols, edges, references=refs, errors=[("bad.py:1:1: invalid syntax", 1)])
    got = {(r.name, r.start_line): r.classification for r in usage.unused_symbols(g).collect()}
    assert got == {("recursive", 11): "unused_candidate", ("noline", 21): "cannot_assess", ("lonely", 31): "unused_candidate", ("__init__", 41): "cannot_assess", ("twin", 101): "cannot_assess", ("twin", 111): "cannot_assess", ("test_x", 1): "cannot_assess", ("b", 1): "cannot_assess"}
    files = {r.path: r.classification for r in usage.unused_files(g).collect()}
    assert files == {"o.py": "unused_candidate", "tests/test_m.py": "cannot_assess", "bad.py": "unused_candidate"}
    summary = {(r.kind, r.classification): r.entities for r in usage.summary(usage.unused_symbols(g)).collect()}
    assert summary[("function", "unused_candidate")] == 2


def test_packages_and_policies(spark):
    g = graph(spark, ["src/a/__init__.py", "src/a/m.py", "src/a/sub/__init__.py", "src/a/sub/n.py", "src/b/__init__.py", "src/b/k.py", "run.py"], edges=[("file:src/a/m.py", "file:src/b/k.py", "imports", 1, 1.0), ("file:src/a/sub/n.py", "file:src/a/m.py", "imports", 1, 1.0), ("file:run.py", "file:src/a/m.py", "imports", 1, 1.0), ("file:src/a/m.py", "file:src/a/__init__.py", "imports", 1, 1.0)])
    found = structure.packages(g.files)
    of = structure.package_of(g.files, found)
    assert {r.path: r.package for r in of.collect()}["src/a/sub/n.py"] == "src/a/sub"
    assert {r.package: r.modules for r in structure.package_modules(g.files, found).collect()} == {"src/a": 4, "src/a/sub": 2, "src/b": 2}
    edges = structure.endpoint_packages(g, of.select("id", "package"))
    assert sorted(r["class"] for r in structure.cross_package(edges).collect()) == ["cross", "cross", "internal", "unclassified"]
    pairs = spark.createDataFrame([("src/a", "src/b"), ("src/a/sub", "src/b"), ("src/b", "src/a"), ("x", "y?")], "source_package string, target_package string")
    rules = [{"source": "src/*", "target": "src/b", "policy": "deny"}, {"source": "src/a/*", "target": "*", "policy": "allow"}, {"source": "src/a", "target": "src/b", "policy": "allow"}, {"source": "x", "target": "y?", "policy": "prohibit"}]
    got = {(r.source_package, r.target_package): r.decision for r in structure.policy(pairs, rules).collect()}
    assert got == {("src/a", "src/b"): "allow", ("src/a/sub", "src/b"): "ambiguous", ("src/b", "src/a"): "unrestricted", ("x", "y?"): "prohibit"}


def test_rules_in_an_incomplete_analysis(spark):
    g = graph(spark, ["ui/view.py", "core/core.py", "db/db.py"], edges=[("file:ui/view.py", "file:core/core.py", "imports", 1, 1.0), ("file:core/core.py", "file:db/db.py", "calls", 1, 1.0)])
    rules = [{"kind": "prohibited_dependency", "source": "ui/*", "target": "db/*"}, {"kind": "layer_boundary", "source": "core", "target": "db/db.py"}, {"kind": "isolated_component", "source": "db"}, {"kind": "layer_boundary", "source": "none", "target": "db"}]
    outcome = lambda: [r.outcome for r in structure.evaluate_rules(g, rules).orderBy("rule_id").collect()]
    assert outcome() == ["no_violation", "violation", "violation", "unevaluable"]
    g.status = "partial"
    assert outcome() == ["unevaluable", "violation", "violation", "unevaluable"]


def test_rules_that_cannot_be_evaluated(spark):
    """Reasons, and names that several files hold: ambiguous but as a glob, by their path, or as a package."""
    files = ["a.py", "b.py", "c.py", "pkg/__init__.py", "pkg/one.py"]
    symbols = [("run", "a.py", "run"), ("run", "b.py", "run"), ("pkg", "a.py", "pkg"), ("pkg", "b.py", "pkg"), ("only", "c.py", "only")]
    vertices = spark.createDataFrame([(f"file:{p}", "file", p.rsplit("/")[-1], p, f"file:{p}", None) for p in files] + [(f"symbol:{p}:{n}", "symbol", n, None, f"file:{p}", q) for n, p, q in symbols], "id string, kind string, name string, path string, file_id string, qualified_name string")
    edges = spark.createDataFrame([("symbol:a.py:run", "symbol:c.py:only", "calls"), ("file:b.py", "file:pkg/one.py", "imports"), ("file:b.py", "file:pkg/one.py", "imports")], "source_id string, target_id string, relationship_type string")

    class Small:
        status = next(iter(structure.COMPLETE))

        def vertices(self):
            return vertices

    g = Small()
    g.edges = edges
    kind = "prohibited_dependency"
    cases = [
        ("run", "only", "unevaluable", "ambiguous", 0), ("run*", "only", "violation", None, 1), ("a.py:run", "only", "violation", None, 1),
        ("b.py", "pkg", "violation", None, 1), ("b.py", "pkg.one", "violation", None, 1), (" ", "only", "unevaluable", "empty_pattern", 0),
        ("a.py", "", "unevaluable", "empty_pattern", 0), ("a.py", None, "unevaluable", "missing_target", 0), ("no*", "only", "unevaluable", "unmatched", 0),
        ("c.py", "a.py", "no_violation", None, 0), ("a", "c", "violation", None, 1),
    ]
    rules = [{"rule_id": f"r{i:02}", "kind": kind, "source": s, "target": t} for i, (s, t, *_) in enumerate(cases)]
    got = structure.evaluate_rules(g, rules).orderBy("rule_id").collect()
    assert [(r.outcome, r.reason, r.hits) for r in got] == [tuple(c[2:]) for c in cases]
    assert structure.evaluate_rules(g, []).count() == 0


def test_globs_paths_and_lines(spark):
    import fnmatch

    names = ["a", "ab", "a/b.py", "a.py", "[x]", "a\nb", "^", "b]"]
    for pattern in ["*", "a*", "?", "[ab]", "[!a]*", "*.py", "[[]x]", "a[", "[]b]", "[^]", "*\n*"]:
        df = spark.createDataFrame([(n,) for n in names], "n string").where(F.col("n").rlike(paths.glob_to_regex(pattern)))
        assert {r.n for r in df.collect()} == {n for n in names if fnmatch.fnmatchcase(n, pattern)}, pattern
    texts = ["", "a", "a\n", "a\r\nb", "a\rb\x0bc\x0cd\x1ce\x1df\x1eg\x85h i j\n\n", "\n"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", paths.split_lines(F.col("t")).alias("l")).orderBy("i").collect()
    assert [r.l for r in got] == [t.splitlines() for t in texts]
    df = spark.createDataFrame([("src/pkg/__init__.py",), ("lib/src/a/b.py",), ("src/a.py",)], "p string")
    assert [tuple(r) for r in df.select(paths.build_module(F.col("p")), paths.query_module(F.col("p"))).collect()] == [("src.pkg", "pkg"), ("a.b", "lib.src.a.b"), ("a", "a")]
    df = spark.createDataFrame([("./a/b/",), ("/r/x/y.py",), ("/q/z",), ("a\\b",)], "p string")
    assert [r[0] for r in df.select(paths.normalise(F.col("p"), "/r")).collect()] == ["a/b", "x/y.py", None, "a/b"]


def test_excerpts_and_headers(spark):
    text = "import os\n@deco(1,\n  2)\nclass A(\n    object):\n    pass\n\nX: int = 3\nasync def go(x):\n    return x\n"
    rows = [("A", "class", 2, 6, text), ("go", "function", 9, 10, text), ("X", "constant", 8, 8, text), ("gone", "function", 9, 10, text), ("A", "class", 50, 60, text), ("A", "class", 2, 6, None), ("y", "import", 1, 1, text)]
    got = lookup.header_status(lookup.excerpts(spark.createDataFrame(rows, "name string, kind string, start_line int, end_line int, content string"), 3)).collect()
    assert [r.status for r in got] == ["available"] * 4 + ["stale_location", "missing_file", "available"]
    assert [r.truncated for r in got][:2] == [True, False] and got[0].excerpt == "@deco(1,\n  2)\nclass A("
    assert [r.header for r in got] == ["valid", "valid", "valid", "stale", "unsupported", "unsupported", "unsupported"]


def test_tasks(spark):
    got = {r.task: r for r in tasks.understand(spark.createDataFrame([("Fix login in src/auth/user.py",), ("explain UserService",), ("  ",), ("test the thing",)], "task string")).collect()}
    assert (got["Fix login in src/auth/user.py"].requested_action, got["Fix login in src/auth/user.py"].target) == ("fix", "src/auth/user.py")
    assert got["explain UserService"].target == "UserService" and got["  "].state == "insufficient" and got["test the thing"].requested_action == "test"


def test_context_is_ranked_and_within_budget(spark, chain):
    got = context.package(chain, "Fix src/a.py", budget=3).collect()
    assert len(got) == 3 and [r.position for r in sorted(got, key=lambda r: r.position)] == [1, 2, 3]
    assert min(got, key=lambda r: r.position).entity_id == ids("a")
    again = context.package(chain, "Fix src/a.py", budget=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def plain_merge(rows):
    """Units as dicts of lists, merged one after another."""
    out = {}
    for entity, kind, relevance, content, items in rows:
        unit = out.setdefault((entity, kind), [relevance, None, {}])
        unit[0] = max(unit[0], relevance)
        unit[1] = content if unit[1] is None else unit[1]
        for group, name, value, evidence in items:
            held = unit[2].setdefault(group, {}).setdefault((name, value), {})
            for e in evidence:
                held.setdefault(e)
    return {k: (r, c, {g: [(n, v, list(e)) for (n, v), e in i.items()] for g, i in items.items()}) for k, (r, c, items) in out.items()}


def test_merged_units(spark):
    """Random units with repeated signals, facts and inferences: keep-first, ordered unions of evidence, first content, highest relevance."""
    rng = random.Random(31)
    rows = []
    for _ in range(40):
        items = [(g, rng.choice("pqr"), rng.choice("xy") if g == "fact" else rng.choice((0.25, 0.5)), [(rng.choice("st"), rng.choice("uv")) for _ in range(rng.randrange(1, 4))]) for g in rng.choices(("signal", "fact", "inference"), k=rng.randrange(4))]
        rows.append((rng.choice("abc"), rng.choice(("file", "symbol")), rng.random(), rng.choice((None, "one", "two")), items))
    flat = [(e, k, i, g, f"{j:03d}", n, v if g == "fact" else None, None if g == "fact" else v, at, s, d) for i, (e, k, _, _, items) in enumerate(rows) for j, (g, n, v, ev) in enumerate(items) for at, (s, d) in enumerate(ev)]
    item = spark.createDataFrame(flat, "entity_id string, entity_type string, ordinal int, kind string, place string, name string, value string, number double, at int, source_id string, description string").repartition(3)
    unit = spark.createDataFrame([(e, k, i, r, c) for i, (e, k, r, c, _) in enumerate(rows)], "entity_id string, entity_type string, ordinal int, relevance double, content string").repartition(3)
    got = {}
    for r in units.nested(units.merge(unit), units.merge_items(item)).collect():
        shown = {g: [(*x[:2], [tuple(e) for e in x[2]]) for x in r[f]] for g, f in (("signal", "signals"), ("fact", "facts"), ("inference", "inferences")) if r[f]}
        got[r.entity_id, r.entity_type] = (r.relevance, r.content, shown)
    assert got == plain_merge(rows)


def test_package_with_its_evidence(spark, chain):
    got = {r.entity_id: r for r in context.package(chain, "Fix src/a.py", budget=3).collect()}
    first, other = got[ids("a")], next(r for r in got.values() if r.position > 1)
    assert [x.name for x in first.signals] == ["selection"] and first.signals[0].evidence[0].source_id == ids("a")
    assert [f.value for f in first.facts if f.fact_type == "file_path"] == ["src/a.py"] and {f.fact_type for f in first.facts} >= {"size", "generated", "relationship"}
    assert all("selected from" in s.evidence[0].description.lower() for r in got.values() for s in r.signals if s.name == "selection") and other.signals
    from graphloom.sources.snapshot import package_json

    text = package_json(context.package(chain, "Fix src/a.py", budget=1)).first().json
    assert text.index('"entity_id"') < text.index('"facts":[{"evidence":[{"description"') < text.index('"signals"')


def test_diffs(spark):
    a = spark.createDataFrame([("same", 1, "h1"), ("edit", 1, "h2"), ("old", 1, "h3"), ("size", 1, None), ("r1", 1, "h5"), ("r2", 1, "h5")], "path string, size long, content_hash string")
    b = spark.createDataFrame([("same", 1, "h1"), ("edit", 1, "hx"), ("new", 1, "h3"), ("size", 1, "h9"), ("n1", 1, "h5")], "path string, size long, content_hash string")
    got = {(r.change, r.path, r.old_path) for r in changes.diff_files(a, b).collect()}
    assert got == {("modified", "edit", None), ("moved", "new", "old"), ("removed", "r1", None), ("removed", "r2", None), ("added", "n1", None), ("ambiguous", "r1", None), ("ambiguous", "r2", None), ("ambiguous", "n1", None)}
    one = graph(spark, ["a.py", "b.py"], [("a.py", "f", "function", 1, 2), ("a.py", "g", "function", 3, 4)])
    two = graph(spark, ["a.py", "b.py"], [("a.py", "f", "function", 5, 6), ("b.py", "g", "function", 3, 4)])
    assert {(r.change, r.path, r.qualified_name) for r in changes.diff_symbols(one, two).collect()} == {("moved", "b.py", "g")}
    assert changes.validate_states(None, {"x": 1})[0]["severity"] == "blocker"
    assert changes.validate_states({"repository": 1, "status": "analyzed"}, {"repository": 2, "status": "analyzed"})[0]["code"] == "repository_mismatch"
    assert changes.cache_reason(None, a, b) == "missing_metadata"
    meta = {"schema_version": changes.SCHEMA_VERSION, "analyzer_version": changes.ANALYZER_VERSION}
    assert changes.cache_reason(meta, a, b) == "files_changed" and changes.cache_reason(meta, a, a.where("content_hash is not null")) == "files_changed" and changes.invalidation("files_changed") == "paths"


def test_metrics(spark):
    rows = [(0, 0, 0), (2, 0, 0), (0, 2, 0), (4, 2, 1), (3, 3, 3)]
    got = metrics.scores(spark.createDataFrame(rows, "expected long, actual long, matched long")).collect()
    assert [(round(r.precision, 3), round(r.recall, 3), round(r.f1, 3)) for r in got] == [(1, 1, 1), (0, 0, 0), (0, 1, 0), (0.5, 0.25, 0.333), (1, 1, 1)]
    twice = spark.createDataFrame([("a", 1.0), ("a", 0.5)], "case string, f1 double")
    with pytest.raises(Exception, match="duplicate"):
        metrics.regression(twice, twice).collect()


def test_classification(spark):
    df = spark.createDataFrame([(p,) for p in ("src/a.py", "tests/t.py", "test_x.py", "x.json", "pyproject.toml", "README.md", "build/x.py", ".gitignore", "a.PY", "a.js", "a.cxx")], "path string")
    got = {r.path: (r.s, r.f, r.l, r.p) for r in df.select("path", classify.scanned_type(F.col("path")).alias("s"), classify.file_type(F.col("path")).alias("f"), classify.language(F.col("path")).alias("l"), classify.parser_language(F.col("path")).alias("p")).collect()}
    # The second pass replaces the first: a test outside ``tests`` is source, other settings are unknown.
    assert got["test_x.py"][:2] == ("test", "source") and got["x.json"][:2] == ("configuration", "unknown") and got["build/x.py"][:2] == ("generated", "source")
    assert got["tests/t.py"][1] == "test" and got["a.cxx"][2:] == (None, "cpp") and got[".gitignore"][:2] == ("configuration", "configuration")
    files = spark.createDataFrame([("a.py", "a.py"), ("package.json", "package.json"), ("uv.lock", "uv.lock"), ("a.go", "a.go")], "name string, path string")
    assert tuple(classify.project(files).first()) == ("javascript_project", "uv", ["Go", "Python"])
    assert [r[0] for r in classify.frameworks(spark.createDataFrame([("a.py", "Import Flask\nimport django"), ("a.js", "import react")], "path string, content string")).orderBy("framework").collect()] == ["Django", "Flask"]


def test_error_attribution(spark):
    files = spark.createDataFrame([("src/a.py", "a.py"), ("src/b.py", "b.py"), ("x/b.py", "b.py")], "path string, name string")
    errors = spark.createDataFrame([("src/a.py:3:1: bad", 1), ("in src/b.py near src/a.py", 2), ("a.py failed", 3), ("b.py failed", 4), ("mysrc/a.pyx", 5)], ERRORS)
    assert {r.ordinal: r.path for r in usage.file_errors(files, errors).collect()} == {1: "src/a.py", 3: "src/a.py"}
    r = {x.ordinal: x for x in history.parse_errors(errors).collect()}[1]
    assert (r.path, r.line, r.column, r.code) == ("src/a.py", 3, 1, "parse_error")


def test_reports(spark, chain):
    roots = spark.createDataFrame([(ids("c"),)], "root string")
    items = {(r.category, r.item) for r in reports.checklist(chain, roots).collect()}
    assert ("caveat", "static_analysis") in items and ("unverified_area", ids("c")) in items
    facts = reports.risk_facts(chain, roots)
    assert {r.concern for r in reports.risk_concerns(facts).collect()} >= {"missing_tests"}
    assert reports.health(chain).first()["status"] == "healthy"
    assert set(reports.architecture(chain)) == {"summary", "modules", "packages", "cycles", "integrity", "unresolved_imports"}
    out = reports.pre_change(chain, spark.createDataFrame([("src/a.py", "x")], "path string, content string"), "src/c.py")
    assert out["resolution"].first()["status"] == "resolved" and out["impact"].count() == 4
    assert reports.freshness("fresh", "analyzed", False) == "current" and reports.freshness("files_changed", "analyzed", False) == "stale" and reports.freshness("fresh", "partial", False) == "incomplete" and reports.freshness("missing_metadata", "analyzed", False) == "indeterminate"
    assert reports.freshness("files_changed", "partial", True) == "stale" and reports.freshness("schema_version_mismatch", "analyzed", False) == "indeterminate"


def test_violations(spark):
    g = graph(spark, ["a.py"], [("a.py", "f", "function", 5, 2)], [("file:a.py", "x", "odd", 1, 2.0)])
    assert {r.rule for r in violations(g).collect()} == {"line_range", "confidence_range", "relationship_type"}


def plain_expansion(edges, candidates, max_depth, most=None):
    """The queue as plain loops over sorted edges; edges of (source, target, type, confidence, id)."""
    ways = {}
    for s, t, kind, c, own in edges:
        ways.setdefault(s, []).append((kind, t, own, c))
        if s != t:
            ways.setdefault(t, []).append((kind, s, own, c))
        else:
            ways[s].append((kind, t, own, c))
    order = sorted(candidates, key=lambda x: (-x[1], x[0]))[:most]
    known, evidence = {n: (s, 0) for n, s in order}, {}
    front = list(order)
    for depth in range(1, max_depth + 1):
        later = []
        for node, score in front:
            for kind, to, own, c in sorted(ways.get(node, [])):
                if most is not None and len(known) >= most:
                    return known, evidence
                if known.get(to, (0, 1))[1] == 0:
                    continue
                new = (min(score, c), -depth, node)
                if to in evidence:
                    if new > evidence[to][0]:
                        evidence[to] = (new, kind)
                    continue
                known[to], evidence[to] = (new[0], depth), (new, kind)
                later.append((to, new[0]))
        front = later
    return known, evidence


def test_expansion_replaces_weaker_evidence(spark):
    """A later level gives stronger evidence than the one before; random graphs agree with plain loops, with and without a limit."""
    rng = random.Random(21)
    cases = [([("a", "b", "calls", 0.2, "e0"), ("a", "c", "calls", 0.9, "e1"), ("c", "b", "imports", 0.9, "e2")], [("a", 0.95)], 2, None)]
    for most in (None, 4, 7):
        nodes = [f"n{i}" for i in range(12)]
        edges = [(rng.choice(nodes), rng.choice(nodes), rng.choice(("calls", "imports")), rng.choice((0.2, 0.5, 0.7, 0.9)), f"e{i:02d}") for i in range(24)]
        cases.append((edges, [(n, rng.choice((0.4, 0.8))) for n in nodes[:2]], 3, most))
    for edges, candidates, depth, most in cases:
        schema = "id string, source_id string, target_id string, relationship_type string, confidence double, metadata map<string,string>"
        rows = spark.createDataFrame([(own, s, t, kind, c, {}) for s, t, kind, c, own in edges], schema)
        files = spark.createDataFrame([(n, "d", n, n, "", "source", 1, False, False) for n in sorted({x for e in edges for x in e[:2]} | {c[0] for c in candidates})], "id string, directory_id string, path string, name string, extension string, file_type string, size long, is_generated boolean, is_ignored boolean")
        g = Graph(spark.createDataFrame([], "id string, path string, name string, parent_id string, depth int, directory_type string"), files, spark.createDataFrame([], "id string, file_id string, name string, kind string, qualified_name string, start_line int, end_line int, parent_symbol_id string, signature string"), rows)
        got = traverse.expand(traverse.adjacency(g, "both", None), spark.createDataFrame(candidates, "entity_id string, score double"), depth, most).collect()
        known, evidence = plain_expansion(edges, candidates, depth, most)
        assert {r.entity_id: (r.score, r.level) for r in got} == known
        assert {r.entity_id: ((r.candidate_confidence, -r.depth, r.from_id), r.relationship_type) for r in got if r.level} == evidence
    first = plain_expansion(*cases[0])
    assert first[0]["b"] == (0.2, 1) and first[1]["b"] == ((0.9, -2, "c"), "imports")


def test_ranks_within_a_hub(spark):
    """A key with half of all rows lies in several ranges, and has the places of one sorted list; the first few come with the count of all."""
    from graphloom.operators import order
    from pyspark.sql import Window

    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hub").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"), F.xxhash64("id").alias("v"), "id")
    df = df.unionByName(spark.createDataFrame([(None, 1, -1), (None, 0, -2)], "k string, v long, id long"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = order.positions_within(df, "k", "v", "id")
        want = df.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")))
        assert sorted(map(tuple, got.select("id", "position").collect())) == sorted(map(tuple, want.select("id", "position").collect()))
        runs = df.orderBy("k", "v", "id").withColumn("r", F.spark_partition_id()).where("k = 'hub'").groupBy("r").count().collect()
        assert len(runs) > 1 and max(r["count"] for r in runs) < 7000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    first = order.first_within(df, "k", "v", "id", limit=3)
    assert {tuple(r) for r in first.select("k", "id", "position").collect()} == {tuple(r) for r in want.where("position <= 3").select("k", "id", "position").collect()}
    assert first.where("k = 'hub'").first()["total"] == 10_000
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()


def test_one_join_finds_broken_pointers(spark, chain):
    plan = structure.integrity(chain)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") <= 2


def plain_path(edges, start, end, most=10):
    """A queue with neighbours by (outgoing first, type, path, name, kind, id, edge id); files' paths are their ids less ``file:``."""
    ways = {}
    for s, t, kind, own in edges:
        ways.setdefault(s, []).append((0, kind, t.removeprefix("file:"), t, own))
        ways.setdefault(t, []).append((1, kind, s.removeprefix("file:"), s, own))
    level, seen = [(start, [])], {start}
    for _ in range(most):
        later = []
        for node, path in level:
            for w in sorted(ways.get(node, [])):
                if w[3] not in seen:
                    seen.add(w[3])
                    later.append((w[3], [*path, w[4]]))
        for node, path in later:
            if node == end:
                return path
        level = later
    return None


def test_paths_from_stored_adjacency(spark, tmp_path):
    """Random graphs: the steps of the path are those of a plain queue, with all edges at hand and from stored buckets; each level reads its own buckets only."""
    rng = random.Random(17)
    names = [f"n{i:02d}.py" for i in range(30)]
    edges = [(f"file:{rng.choice(names)}", f"file:{rng.choice(names)}", rng.choice(("imports", "calls")), i, 1.0) for i in range(45)]
    g = graph(spark, names, edges=edges)
    own = {(r.source_id, r.target_id, r.relationship_type): r.id for r in g.edges.collect()}
    plain = sorted({(s, t, k, own[s, t, k]) for s, t, k, _, _ in edges})
    folder = traverse.store_adjacency(g, str(tmp_path / "adjacent"), 16)
    for start, end in rng.sample([(f"file:{a}", f"file:{b}") for a in names for b in names if a != b], 3):
        want = plain_path(plain, start, end)
        for stored in (None, folder):
            got = traverse.find_path(g, start, end, stored_in=stored)
            assert [s["edge_id"] for s in got["path"]] == (want or []) and (got["status"] == "resolved") == (want is not None)
    rows = traverse.stored_ways(g, folder, "both", None)(["file:n00.py", "file:n01.py"])
    assert {r.from_id for r in rows.collect()} <= {"file:n00.py", "file:n01.py"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert len({f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}) <= 16


def test_breadth_first_trees_and_walks(spark, chain):
    tree = traverse.bfs_tree(traverse.adjacency(chain, "both", None), spark.createDataFrame([("r", ids("a"))], "root string, node string"), 4)
    paths_ = traverse.walk(tree, tree.select("root", "node")).collect()
    depth = {r.node: r.depth for r in tree.collect()}
    for node, n in depth.items():
        steps = sorted((r.hop, r.from_id, r.to_id) for r in paths_ if r.node == node)
        assert [h for h, _, _ in steps] == list(range(1, n + 1)) and steps[0][1] == ids("a") and steps[-1][2] == node
        assert all(x[2] == y[1] for x, y in zip(steps[:-1], steps[1:], strict=True))
    assert traverse.bfs_tree(traverse.adjacency(chain, "both", None), spark.createDataFrame([("r", "none")], "root string, node string"), 2).count() == 0


def test_both_sides_of_an_edge_diff_are_keyed_once(spark):
    """Parallel, missing and changed edges, as when each side is grouped by itself; the query asks for its edges once."""
    from graphloom.operators import changes
    from graphloom.plans import text_queries

    row = lambda s, t, c, d="x": (s, t, "references", c, d)
    make = lambda rows: spark.createDataFrame(rows, "source_key string, target_key string, relationship_type string, confidence double, detail string")
    before = make([row("a", "b", 1.0), row("a", "c", 1.0), row("a", "d", 1.0), row("p", "q", 1.0), row("p", "q", 0.5), row("r", "s", 1.0), row("r", "s", 1.0), row("k", "k", 1.0, None)])
    after = make([row("a", "b", 0.5), row("a", "d", 1.0), row("a", "e", 1.0), row("p", "q", 1.0), row("r", "s", 1.0), row("r", "s", 1.0), row("k", "k", 1.0, None)])
    got = {(r.change, r.source_key, r.target_key) for r in changes.diff_edges(before, after).collect()}
    assert got == {("modified", "a", "b"), ("removed", "a", "c"), ("added", "a", "e"), ("ambiguous", "p", "q")}
    plan = text_queries.edge_diff(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem") + plan.count("l_suppkey#") > 0 and plan.count("Join FullOuter") == 0 and plan.count("Relation [l_orderkey") <= 2
