"""Incremental linking against a full build."""

import random

from graphloom.operators import link, relink
from graphloom.schema import Graph
from graphloom.sources import parse
from graphloom.streaming import incremental
from pyspark.sql import Observation
from pyspark.sql import functions as F

LINKED = ("files", "symbols", "imports", "references", "inheritance", "errors", "edges", "names", "referrers")


def graph(spark, sources):
    """A full build of {path: text}."""
    rows = spark.createDataFrame([(f"file:{p}", p, t) for p, t in sources.items()], "id string, path string, content string")
    parts = parse.tables(parse.parse_files(rows))
    none = spark.createDataFrame([], "id string, path string, name string, parent_id string, depth int, directory_type string")
    nothing = Graph(none, spark.createDataFrame([], "id string, directory_id string, path string, name string, extension string, file_type string, size bigint, is_generated boolean, is_ignored boolean"), *(parts[n].limit(0) for n in ("symbols",)), link.defines(parts["symbols"].limit(0)), *(parts[n].limit(0) for n in ("imports", "references", "inheritance", "errors")))
    versions = rows.select("path", "content", F.lit("2024-01-01").cast("timestamp").alias("at"))
    files = incremental.apply_versions(nothing, versions).files
    g = Graph(none, files, parts["symbols"], None, parts["imports"], parts["references"], parts["inheritance"], parts["errors"])
    g.edges = link.build_edges(g)
    return relink.indexed(g)


def rows(df):
    plain = lambda v: sorted(v.items()) if isinstance(v, dict) else v
    return sorted(str([plain(v) for v in r]) for r in df.select(sorted(df.columns)).collect())


def source(rng, names):
    out = []
    for _ in range(rng.randrange(1, 4)):
        out.append(rng.choice((f"from {rng.choice(names)} import {rng.choice('PQRS')}" + rng.choice(("", " as Z")), f"import {rng.choice(names)}", f"from . import {rng.choice(names)}", f"from .{rng.choice(names)} import {rng.choice('pqr')}")))
    for _ in range(rng.randrange(1, 4)):
        out.append(rng.choice((f"class {rng.choice('PQRS')}({rng.choice(('P', 'Q', 'Z', 'a.P', 'object'))}):\n    def {rng.choice('pqr')}(self): return {rng.choice('pqrPQ')}", f"def {rng.choice('pqr')}(): return {rng.choice(('Z', 'p', 'P.q', 'Q'))}", f"x = {rng.choice(('q()', 'Z', 'R.p', 'a.b'))}")))
    return "\n".join(out) + "\n"


def test_random_edits_equal_a_full_build(spark):
    rng = random.Random(12)
    names = list("abcdef")
    paths = [f"src/{n}.py" for n in names] + ["src/k/__init__.py", "src/k/a.py", "lib/b.py"]
    held = {p: source(rng, names) for p in paths[:7]}
    g = graph(spark, held)
    for step in range(3):
        edits = {p: None if p in held and rng.random() < 0.35 else source(rng, names) for p in rng.sample(paths, 2)}
        versions = spark.createDataFrame([(p, t) for p, t in edits.items()], "path string, content string").withColumn("at", F.lit(f"2024-01-0{step + 1}").cast("timestamp"))
        g = incremental.apply_versions(g, versions)
        held = {p: t for p, t in (held | edits).items() if t is not None}
        want = graph(spark, held)
        for name in LINKED:
            assert rows(getattr(g, name)) == rows(getattr(want, name)), (step, name)
        g = Graph(**{k: spark.createDataFrame(v.collect(), v.schema) if hasattr(v, "collect") else v for k, v in vars(g).items()})


def test_only_what_a_change_concerns_is_resolved_again(spark):
    """A file of a hundred is edited: a common name gains a symbol and costs nothing, a name that stops being the only one costs its referrers."""
    held = {f"m{i:02d}.py": f"def f{i}(): return common() + f{(i + 1) % 100}() + g{i % 10}()\ndef common(): pass\n" for i in range(100)}
    held["g.py"] = "".join(f"def g{i}(): pass\n" for i in range(10))
    g = graph(spark, held)
    g = Graph(**{k: spark.createDataFrame(v.collect(), v.schema) if hasattr(v, "collect") else v for k, v in vars(g).items()})

    def refreshed(path, text):
        seen = Observation()
        versions = spark.createDataFrame([(path, text)], "path string, content string").withColumn("at", F.lit("2024-02-01").cast("timestamp"))
        after = incremental.apply_versions(g, versions, relinked=seen)
        assert rows(after.edges) == rows(graph(spark, held | {path: text}).edges)
        return seen.get["references"]

    # Its own reference alone: the name was common before and is common after.
    assert refreshed("new.py", "def other(): return common()\ndef common(): pass\n") == 1
    # Ten files refer to g3, three references each, and the new file to nothing.
    assert refreshed("new.py", "def g3(): pass\n") == 30
    # A body changes and no name: the file alone.
    assert refreshed("m07.py", "def f7(): return common() + f9()\ndef common(): pass\n") == 2
