"""Queries over operators that work on paths, texts, errors and evaluation cases, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import changes, classify, link, lookup, metrics, search, structure, usage
from ..session import table
from ..sources import parse, tree
from . import bindings, reports
from .parse_queries import _graph, _sources

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _k(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_size")


def _pick(by: int, *values: str):
    """One of the texts by k modulo ``by``, with k in place of %d."""
    column = F.lit(None).cast("string")
    for i, value in reversed(list(enumerate(values))):
        column = F.when(F.col("k") % by == i, F.format_string(value, "k") if "%d" in value else F.lit(value)).otherwise(column)
    return column


@query(
    "scanned_types",
    """SELECT CASE p_partkey % 9 WHEN 0 THEN 'tests/test_m' || p_partkey || '.py' WHEN 1 THEN 'docs/g' || p_partkey || '.md' WHEN 2 THEN 'build/m' || p_partkey || '.py' WHEN 3 THEN 'conf/s' || p_partkey || '.toml'
  WHEN 4 THEN 'src/m' || p_partkey || '_test.py' WHEN 5 THEN 'data/d' || p_partkey || '.csv' WHEN 6 THEN 'static/i' || p_partkey || '.png' WHEN 7 THEN 'src/m' || p_partkey || '.py' ELSE 'site-packages/x' || p_partkey || '.so' END AS path,
  ['test', 'documentation', 'generated', 'configuration', 'test', 'data', 'asset', 'source', 'dependency'][p_partkey % 9 + 1] AS scanned_type, p_partkey % 9 = 2 AS generated,
  ['tests', 'documentation', 'generated', 'unknown', 'source', 'unknown', 'assets', 'source', 'dependency'][p_partkey % 9 + 1] AS directory_type FROM part""",
)
def scanned_types(spark, d):
    """What the scan makes of a path and of its first directory."""
    path = _pick(9, "tests/test_m%d.py", "docs/g%d.md", "build/m%d.py", "conf/s%d.toml", "src/m%d_test.py", "data/d%d.csv", "static/i%d.png", "src/m%d.py", "site-packages/x%d.so")
    rows = _k(spark, d).select(path.alias("path"))
    return rows.select("path", classify.scanned_type(F.col("path")).alias("scanned_type"), classify.is_generated(F.col("path")).alias("generated"), classify.directory_type(F.split("path", "/")[0]).alias("directory_type"))


@query("project_kind", "SELECT 'python_project' AS project_type, 'uv' AS package_manager, 'JavaScript,Python' AS languages WHERE (SELECT count(*) FROM part) > 3")
def project_kind(spark, d):
    """Type, package manager and languages of a tree of as many files as there are parts."""
    rows = _k(spark, d).select(_pick(4, "pyproject.toml", "uv.lock", "src/m%d.py", "web/m%d.js").alias("path"))
    found = classify.project(rows.withColumn("name", paths.name_of(F.col("path"))))
    return found.select("project_type", "package_manager", F.array_join("languages", ",").alias("languages"))


@query("frameworks_found", "SELECT DISTINCT ['FASTAPI', 'Django', 'Flask'][p_partkey % 4 + 1] AS framework FROM part WHERE p_partkey % 4 < 3")
def frameworks_found(spark, d):
    """Frameworks by the imports in Python files; other files don't count."""
    content = _pick(4, "import fastapi\n", "x = 1\nIMPORT Django.db\n", "import flask as f%d\n", "import react\n")
    return classify.frameworks(_k(spark, d).select(content.alias("content"), F.when(F.col("k") % 4 == 3, F.format_string("m%d.js", "k")).otherwise(F.format_string("m%d.py", "k")).alias("path")))


@query("content_hashes", "SELECT CAST(doc_id AS VARCHAR) AS path, strlen(text) AS size, sha256(text) AS content_hash FROM documents")
def content_hashes(spark, d):
    """Fingerprints of every document."""
    text = F.col("text").cast("binary")
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), text.alias("content"), F.octet_length(text).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("modified_at_ns"))
    return tree.fingerprints(rows).drop("modified_at_ns")


@query("snapshot_reasons", """WITH p AS (SELECT s_suppkey AS r, p_partkey AS k FROM supplier JOIN (SELECT p_partkey, min(l_suppkey) AS s FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1) ON s = s_suppkey),
n AS (SELECT r, count(*) FILTER (r % 11 <> 4) AS had, count(*) FILTER (r % 11 <> 5) AS has, count(*) FILTER (k % 40 = 7 AND r % 3 = 0) AS changed FROM p GROUP BY 1),
w AS (SELECT s_suppkey AS r, CASE WHEN s_suppkey % 11 = 1 THEN 'missing_metadata' WHEN s_suppkey % 11 = 2 THEN 'schema_version_mismatch' WHEN s_suppkey % 11 = 3 THEN 'analyzer_version_mismatch' WHEN coalesce(had, 0) = 0 THEN 'missing_fingerprints'
  WHEN has = 0 THEN 'missing_current_fingerprints' WHEN changed > 0 THEN 'files_changed' ELSE 'fresh' END AS reason FROM supplier LEFT JOIN n ON r = s_suppkey WHERE r IS NOT NULL OR s_suppkey % 11 <> 1)
SELECT r AS repository, reason, CASE reason WHEN 'fresh' THEN 'none' WHEN 'files_changed' THEN 'paths' ELSE 'full' END AS action FROM w""")
def snapshot_reasons(spark, d):
    """K4, K6: why the snapshot of each supplier's parts can't be used as it is, and what goes."""
    home = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_suppkey").alias("repository"))
    prints = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.md5("p_name").alias("hash")).join(home, "k").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("repository")), "repository")
    prints = prints.select("repository", "k", F.format_string("src/m%d.py", "k").alias("path"), "hash")
    r = F.col("repository") % 11
    cached = prints.where(r != 4).select("repository", "path", F.col("hash").alias("content_hash"))
    current = prints.where(r != 5).select("repository", "path", F.when((F.col("k") % 40 == 7) & (F.col("repository") % 3 == 0), "other").otherwise(F.col("hash")).alias("content_hash"))
    metadata = table(spark, d, "supplier").select(F.col("s_suppkey").alias("repository")).where(r != 1)
    metadata = metadata.withColumns({"schema_version": F.when(r == 2, 0).otherwise(changes.SCHEMA_VERSION), "analyzer_version": F.when(r == 3, "0").otherwise(changes.ANALYZER_VERSION)})
    return changes.cache_reasons(metadata, cached, current)


@query("errors_kept", "SELECT 'src/m' || p_partkey || '.py:1: broken' AS message, CAST(p_partkey AS BIGINT) AS ordinal FROM part WHERE p_partkey % 4 <> 0")
def errors_kept(spark, d):
    """K6: errors of the files that stay."""
    k = _k(spark, d)
    errors = k.select(F.format_string("src/m%d.py:1: broken", "k").alias("message"), F.col("k").cast("bigint").alias("ordinal"))
    return changes.without_errors(errors, k.where("k % 4 = 0").select(F.format_string("src/m%d.py", "k").alias("path")))


@query("qualified_changes", "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'deleted' WHEN p_partkey % 3 = 1 THEN 'modified' ELSE 'unchanged' END AS change, 'incomplete_analysis' AS qualification, count(*) AS changes FROM part GROUP BY 1")
def qualified_changes(spark, d):
    """Changes of an incomplete analysis say so."""
    before = _k(spark, d).select("k", F.format_string("src/m%d.py", "k").alias("path"), F.md5("p_name").alias("content_hash"))
    after = before.where("k % 3 <> 0").withColumn("content_hash", F.when(F.col("k") % 3 == 1, F.lit("new")).otherwise(F.col("content_hash")))
    rows = changes.qualified(changes.file_changes(before, after), False)
    return rows.groupBy("change", "qualification").agg(F.count("*").alias("changes"))


@query(
    "parsed_references",
    """WITH p AS (SELECT 'file:src/m' || p_partkey || '.py' AS file_id, p_partkey AS k FROM part WHERE p_partkey % 50 <> 49)
SELECT file_id, 'Base' AS name, 5 AS line, 8 + length('' || k) AS col, 'reference' AS kind, 0 AS place FROM p UNION ALL SELECT file_id, 'int', 6, 10, 'reference', 1 FROM p UNION ALL SELECT file_id, 'int', 8, 28, 'reference', 2 FROM p
UNION ALL SELECT file_id, 'LIMIT', 9, 15, 'reference', 3 FROM p UNION ALL SELECT file_id, 'x', 9, 23, 'reference', 4 FROM p UNION ALL SELECT file_id, 'C' || k, 12, 11, 'reference', 5 FROM p""",
)
def parsed_references(spark, d):
    """T5: every reference with its place, in the order of the file."""
    found = parse.tables(parse.parse_files(_sources(spark, d)))["references"]
    return found.select("file_id", "name", "line", "col", "kind", (F.col("ordinal") % (1 << 20)).cast("int").alias("place"))


@query("parsed_spans", """WITH p AS (SELECT 'src/m' || p_partkey || '.py' AS path, p_partkey AS k FROM part WHERE p_partkey % 50 <> 49)
SELECT 'C' || k || '.area' AS qualified_name, 8 AS start_line, 9 AS end_line, 'symbol:' || path || ':class:C' || k || ':5:0' AS parent_symbol_id FROM p UNION ALL SELECT 'C' || k || '.size', 6, 6, 'symbol:' || path || ':class:C' || k || ':5:0' FROM p
UNION ALL SELECT 'C' || k, 5, 9, NULL FROM p UNION ALL SELECT 'make_' || k, 11, 12, NULL FROM p""")
def parsed_spans(spark, d):
    """Last lines and parents of classes, functions, methods and their variables."""
    found = parse.tables(parse.parse_files(_sources(spark, d)))["symbols"].where("kind not in ('import', 'constant')")
    return found.select("qualified_name", "start_line", "end_line", "parent_symbol_id")


@query(
    "linked_references",
    """WITH p AS (SELECT p_partkey AS k, (p_partkey + 1) % (SELECT count(*) FROM part) AS n FROM part WHERE p_partkey % 50 <> 49)
SELECT 'file:src/m' || k || '.py' AS source_id, 'symbol:src/m' || k || '.py:class:C' || k || ':5:0' AS target_id, 'references' AS relationship_type, CAST(0.8 AS DOUBLE) AS confidence, '12' AS line FROM p
UNION ALL SELECT 'file:src/m' || k || '.py', 'symbol:src/m' || k || '.py:constant:LIMIT:3:0', 'references', 0.8, '9' FROM p
UNION ALL SELECT 'file:src/m' || k || '.py', 'symbol:src/m' || n || '.py:class:C' || n || ':5:0', 'references', 0.9, '5' FROM p WHERE n % 50 <> 49
UNION ALL SELECT 'symbol:src/m' || k || '.py:class:C' || k || ':5:0', 'symbol:src/m' || n || '.py:class:C' || n || ':5:0', 'inherits', 0.9, '5' FROM p WHERE n % 50 <> 49
UNION ALL SELECT 'symbol:src/m' || k || '.py:class:C' || k || ':5:0', 'symbol:src/m' || k || '.py:method:C' || k || '.area:8:0', 'contains', 1.0, NULL FROM p
UNION ALL SELECT 'symbol:src/m' || k || '.py:class:C' || k || ':5:0', 'symbol:src/m' || k || '.py:variable:C' || k || '.size:6:0', 'contains', 1.0, NULL FROM p""",
)
def linked_references(spark, d):
    """Every such edge with its ends, confidence and line."""
    edges = _graph(spark, _sources(spark, d)).edges.where("relationship_type in ('references', 'inherits', 'contains')")
    return edges.select("source_id", "target_id", "relationship_type", "confidence", F.try_element_at("metadata", F.lit("line")).alias("line"))


@query(
    "relative_imports",
    """WITH p AS (SELECT p_partkey AS k, (p_partkey + 1) % (SELECT count(*) FROM part) AS n FROM part)
SELECT 'file:pkg/p' || k || '/m.py' AS file_id, 2 AS level, 'X' AS imported_name, 'file:pkg/p' || n || '/m.py' AS target_id FROM p UNION ALL SELECT 'file:pkg/p' || k || '/m.py', 1, 'missing', NULL FROM p
UNION ALL SELECT 'file:pkg/p' || k || '/m.py', 1, 'm', 'file:pkg/p' || k || '/m.py' FROM p UNION ALL SELECT 'file:pkg/p' || k || '/m.py', 5, 'y', NULL FROM p""",
)
def relative_imports(spark, d):
    """Imports that climb, by parsed source; past the top they resolve to nothing."""
    k = _k(spark, d)
    n = k.count()
    path = F.format_string("pkg/p%d/m.py", "k")
    text = F.format_string("from ..p%d.m import X\nfrom . import missing\nfrom . import m\nfrom ..... import y\n", (F.col("k") + 1) % n)
    files = k.select(F.concat(F.lit("file:"), path).alias("id"), path.alias("path"), text.alias("content"))
    found = parse.tables(parse.parse_files(files))["imports"]
    return link.resolve_imports(files.drop("content"), found).select("file_id", "level", "imported_name", "target_id")


@query("unresolved_module_imports", "SELECT 'file:src/m' || p_partkey || '.py' AS file_id, 'os.path' AS module_name FROM part WHERE p_partkey % 50 <> 49")
def unresolved_module_imports(spark, d):
    """A2: imports of nothing in the tree."""
    sources = _sources(spark, d)
    found = parse.tables(parse.parse_files(sources))["imports"]
    return structure.unresolved_imports(sources.drop("content"), found).select("file_id", "module_name")


@query("tests_by_name", "SELECT CASE s_suppkey % 2 WHEN 0 THEN 'tests/test_supplier_' || s_suppkey || '.py' ELSE 'tests/Supplier_' || s_suppkey || '_test.py' END AS test_path, 'file:' || s_suppkey AS target_id, 'naming_convention' AS evidence FROM supplier WHERE s_suppkey % 5 <> 0")
def tests_by_name(spark, d):
    """Tests named after files; pairs that an edge links are left out."""
    k = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    rows = k.select("k", _pick(2, "tests/test_supplier_%d.py", "tests/Supplier_%d_test.py").alias("test_path"), F.format_string("file:%d", "k").alias("target_id"), F.format_string("supplier_%d", "k").alias("stem"))
    return usage.named_tests(rows.select("test_path"), rows.select("target_id", "stem"), rows.where("k % 5 = 0").select("test_path", "target_id"))


@query(
    "tests_by_symbol_name",
    """SELECT 'tests/test_all.py' AS test_path, 'symbol:' || p_partkey AS target_id, 'symbol_name_match' AS evidence, 'part_' || p_partkey AS matched FROM part WHERE p_partkey % 3 <> 2
UNION ALL SELECT 'tests/test_all.py', 'symbol:' || p_partkey, 'symbol_name_match', 'test_part_' || p_partkey FROM part WHERE p_partkey % 3 = 2""",
)
def tests_by_symbol_name(spark, d):
    """Tests that name a target's symbol, or hold a test of that name."""
    k = _k(spark, d)
    targets = k.select(F.format_string("symbol:%d", "k").alias("target_id"), F.format_string("part_%d", "k").alias("name"))
    named = k.select(F.lit("tests/test_all.py").alias("test_path"), F.when(F.col("k") % 3 == 2, F.format_string("test_part_%d", "k")).otherwise(F.format_string("part_%d", "k")).alias("name"))
    return usage.tests_by_symbol(named, targets)


@query("errors_by_file", "SELECT 'src/m' || p_partkey || '.py' AS path, count(*) AS errors FROM part WHERE p_partkey % 3 < 2 GROUP BY 1")
def errors_by_file(spark, d):
    """errors that name a file at their start or by its only name."""
    k = _k(spark, d)
    files = k.select(F.format_string("src/m%d.py", "k").alias("path"), F.format_string("m%d.py", "k").alias("name"))
    errors = k.select(F.col("k").cast("bigint").alias("ordinal"), _pick(3, "src/m%d.py:4:1: bad", "failed on m%d.py at last", "nothing to say of %d").alias("message"))
    return usage.file_errors(files, errors).groupBy("path").agg(F.count("*").alias("errors"))


@query("header_states", "SELECT p_partkey AS k, ['valid', 'valid', 'stale', 'unsupported', 'valid'][p_partkey % 5 + 1] AS header FROM part")
def header_states(spark, d):
    """whether an excerpt begins with its definition."""
    text = _pick(5, "class N%d(Base):\n    pass", "# note\n@keep(1)\nasync def N%d(x):\n    pass", "def other_%d():\n    pass", "import N%d", "N%d: int = 4")
    rows = _k(spark, d).select("k", F.format_string("N%d", "k").alias("name"), _pick(5, "class", "function", "function", "import", "constant").alias("kind"), text.alias("excerpt"))
    return lookup.header_status(rows).select("k", "header")


@query(
    "changeset_states",
    "SELECT s_suppkey AS k, ['indexed', 'unindexed', 'outside_root', 'invalid', 'indexed', 'outside_root'][s_suppkey % 6 + 1] AS status, CASE WHEN s_suppkey % 6 IN (0, 4) THEN 'file:src/m' || s_suppkey || '.py' END AS id FROM supplier",
)
def changeset_states(spark, d):
    """What each path of a change set is to the snapshot."""
    k = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    files = k.where("k % 6 in (0, 4)").select(F.format_string("file:src/m%d.py", "k").alias("id"), F.format_string("src/m%d.py", "k").alias("path"))
    asked = k.select("k", _pick(6, "src/m%d.py", "src/new%d.py", "../other/m%d.py", "  ", "/work/tree/src/m%d.py", "/elsewhere/m%d.py").alias("path"))
    return lookup.changeset_paths(files, asked, "/work/tree").select("k", "status", "id")


@query(
    "ranked_with_signals",
    bindings.COMMERCE + """, ends AS (SELECT source_id AS entity_id, relationship_type, confidence FROM edges UNION ALL SELECT target_id, relationship_type, confidence FROM edges),
s AS (SELECT entity_id, coalesce(max(confidence) FILTER (relationship_type IN ('defines', 'contains')), 0) AS structural, coalesce(max(confidence) FILTER (relationship_type IN ('imports', 'references', 'inherits', 'calls')), 0) AS dependency FROM ends GROUP BY 1),
r AS (SELECT id AS entity_id, kind AS entity_type, (CAST(contains(lower(name), 'a') AS INT) + CAST(contains(lower(name), 'green') AS INT) + CAST(contains(lower(name), 'supplier') AS INT)) / 3.0 AS task, coalesce(structural, 0) AS structural, coalesce(dependency, 0) AS dependency FROM vertices LEFT JOIN s ON id = entity_id)
SELECT entity_id, round(CAST(least(1, 0.1 + task + 0.2 * structural + 0.3 * dependency) AS DOUBLE), 6) AS final_score FROM r""",
)
def ranked_with_signals(spark, d):
    """The final score of every entity from relevance to a task and its edges."""
    graph = bindings.commerce(spark, d)
    rows = graph.vertices().select(F.col("id").alias("entity_id"), F.col("kind").alias("entity_type"), "name").join(search.edge_signals(graph.edges), "entity_id", "left")
    task = search.task_relevance(F.array("name"), F.lit(None).cast("string"), F.array(*map(F.lit, ("a", "green", "supplier"))))
    rows = rows.select("entity_id", "entity_type", F.lit(0.1).alias("score"), task.alias("task"), (0.2 * F.col("structural")).alias("structural"), (0.3 * F.col("dependency")).alias("dependency"))
    return search.rank(rows, ["task", "structural", "dependency"]).select("entity_id", F.round("final_score", 6).alias("final_score"))


_COUNTS = """WITH e AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS m FROM lineitem WHERE l_quantity > 25), a AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS m FROM lineitem WHERE l_discount <= 0.05),
c AS (SELECT k, count(*) FILTER (x) AS expected, count(*) FILTER (y) AS actual, count(*) FILTER (x AND y) AS matched FROM (SELECT coalesce(e.k, a.k) AS k, e.k IS NOT NULL AS x, a.k IS NOT NULL AS y FROM e FULL JOIN a ON e.k = a.k AND e.m = a.m) GROUP BY 1),
s AS (SELECT *, CASE WHEN actual > 0 THEN matched / CAST(actual AS DOUBLE) WHEN expected = 0 THEN 1 ELSE 0 END AS p, CASE WHEN expected > 0 THEN matched / CAST(expected AS DOUBLE) ELSE 1 END AS r FROM c) """


def _retrieved(spark, d):
    item = table(spark, d, "lineitem")
    members = lambda when: item.where(when).select(F.col("l_suppkey").alias("case"), F.col("l_partkey").alias("member"))
    return metrics.scores(metrics.set_counts(members("l_quantity > 25"), members("l_discount <= 0.05"), ["case"]))


@query("retrieval_metrics", _COUNTS + 'SELECT k AS "case", expected, actual, matched, round(p, 9) AS "precision", round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM s')
def retrieval_metrics(spark, d):
    """M3, M4: what was retrieved against what was expected, by case."""
    return _retrieved(spark, d).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("end_to_end_cases", _COUNTS + """SELECT k AS "case", actual <= 20 AS within_budget, k % 3 <> 0 AS deterministic, actual <= 20 AND k % 3 <> 0 AND r = 1 AS passed FROM s""")
def end_to_end_cases(spark, d):
    """M5: cases that stay in the budget, repeat themselves and miss nothing."""
    rows = _retrieved(spark, d).withColumn("units", F.col("actual")).withColumn("budget", F.lit(20)).withColumn("first_digest", F.md5(F.col("case").cast("string")))
    rows = rows.withColumn("second_digest", F.when(F.col("case") % 3 == 0, F.lit("other")).otherwise(F.col("first_digest")))
    return metrics.end_to_end(rows).select("case", "within_budget", "deterministic", "passed")


@query(
    "risk_concern_rows",
    """WITH f AS (SELECT ['downstream_component', 'package_crossing', 'changed_root'][p_partkey % 3 + 1] AS fact, 'symbol:' || p_partkey AS node FROM part),
t AS (SELECT fact, node, row_number() OVER (PARTITION BY fact ORDER BY node) AS r FROM (SELECT DISTINCT fact, node FROM f))
SELECT 'warning' AS severity, CASE fact WHEN 'downstream_component' THEN 'downstream_impact' ELSE 'package_boundary' END AS concern, (SELECT count(*) FROM f WHERE f.fact = t.fact) AS n, string_agg(node, ',' ORDER BY node) AS evidence FROM t WHERE r <= 10 AND fact <> 'changed_root' GROUP BY fact
UNION ALL SELECT 'warning', 'missing_tests', 0, '' UNION ALL SELECT 'error', 'incomplete_analysis', 0, ''""",
)
def risk_concern_rows(spark, d):
    """Concerns from facts, with the first ten nodes as evidence."""
    facts = _k(spark, d).select(_pick(3, "downstream_component", "package_crossing", "changed_root").alias("fact"), F.format_string("symbol:%d", "k").alias("node"), F.lit("").alias("text"))
    return reports.risk_concerns(facts, True).select("severity", "concern", "n", F.array_join("evidence", ",").alias("evidence"))
