"""Queries on tests, checklists and risk of a change, and on what their inputs mean, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tasks
from ..operators import changes, classify, lookup, metrics, search, traverse, usage
from ..schema import Graph, edge_id
from ..session import checkpoint, table
from . import assurance
from .bindings import COMMERCE, commerce
from .graph_queries import _closure, _customers, _root

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Names that the checklist shows of an item, and rules of the package policy.
SHOWN = 5
POLICY = [
    {"source": "EUROPE/*", "target": "ASIA/*", "policy": "deny", "rule_id": "no-east"},
    {"source": "*/*", "target": "AFRICA/*", "policy": "allow", "rule_id": "to-africa"},
    {"source": "AMERICA/*", "target": "*/*", "policy": "deny", "rule_id": "from-america"},
]


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def _tested(spark, d) -> tuple[Graph, object]:
    """Suppliers as files with parts as symbols, customers as test files with orders as tests; every third customer has an edge to a supplier."""
    supplier, part, customer, orders = (table(spark, d, t) for t in ("supplier", "part", "customer", "orders"))
    s, c = F.col("s_suppkey").cast("string"), F.col("c_custkey").cast("string")
    suppliers = supplier.count()
    null = F.lit(None).cast("string")

    def files(df, node, path, kind):
        return df.select(F.concat(F.lit("file:"), node).alias("id"), null.alias("directory_id"), path.alias("path"), F.substring_index(path, "/", -1).alias("name"), F.lit(".py").alias("extension"), F.lit(kind).alias("file_type"), F.lit(0).cast("bigint").alias("size"), F.lit(False).alias("is_generated"), F.lit(False).alias("is_ignored"))

    def symbols(df, node, owner, name):
        return df.select(F.concat(F.lit("symbol:"), node).alias("id"), F.concat(F.lit("file:"), owner).alias("file_id"), name.alias("name"), F.lit("function").alias("kind"), name.alias("qualified_name"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), null.alias("parent_symbol_id"), null.alias("signature"))

    test_path = F.concat(F.lit("checks/"), c, F.lit("/test_s"), (F.col("c_custkey") % 25).cast("string"), F.lit(".py"))
    made = files(supplier, F.concat(F.lit("s"), s), F.concat(F.lit("src/s"), s, F.lit(".py")), "source").unionByName(files(customer, F.concat(F.lit("t"), c), test_path, "source"))
    p, o = F.col("p_partkey"), F.col("o_orderkey")
    named = symbols(part, F.concat(F.lit("p"), p.cast("string")), F.concat(F.lit("s"), (p % suppliers + 1).cast("string")), F.concat(F.lit("P"), p.cast("string")))
    tests = symbols(orders, F.concat(F.lit("o"), o.cast("string")), F.concat(F.lit("t"), F.col("o_custkey").cast("string")), F.concat(F.lit("test_p"), (o % 3000).cast("string"), F.when(o % 2 == 0, "_works").otherwise("")))
    to = F.concat(F.lit("file:s"), (F.col("c_custkey") % suppliers + 1).cast("string"))
    test = F.concat(F.lit("file:t"), c)
    out = customer.where("c_custkey % 3 = 0").select(test.alias("source_id"), to.alias("target_id"), F.when(F.col("c_custkey") % 2 == 0, "imports").otherwise("references").alias("relationship_type"))
    back = customer.where("c_custkey % 33 = 0").select(to.alias("source_id"), test.alias("target_id"), F.lit("calls").alias("relationship_type"))
    edges = out.unionByName(back).withColumns({"id": edge_id(F.col("source_id"), F.col("target_id"), F.col("relationship_type")), "confidence": F.lit(1.0), "metadata": F.create_map().cast("map<string,string>")})
    directories = spark.createDataFrame([], "id string, path string, name string, parent_id string, depth int, directory_type string")
    targets = supplier.select(F.concat(F.lit("file:s"), s).alias("target_id"), F.when(F.col("s_suppkey") % 4 == 0, "root").otherwise("downstream").alias("target_kind"))
    return Graph(directories, made, named.unionByName(tests), edges), targets.unionByName(part.where("p_partkey % 20 = 0").select(F.concat(F.lit("symbol:p"), p.cast("string")).alias("target_id"), F.lit("root").alias("target_kind")))


_MET = """WITH n AS (SELECT count(*) AS n FROM supplier), tests AS (SELECT c_custkey AS c, 'checks/' || c_custkey || '/test_s' || (c_custkey % 25) || '.py' AS test_path FROM customer),
t AS (SELECT 'file:s' || s_suppkey AS target_id, 's' || s_suppkey || '.py' AS target_name, CASE WHEN s_suppkey % 4 = 0 THEN 'root' ELSE 'downstream' END AS target_kind, s_suppkey AS home, NULL AS part FROM supplier
  UNION ALL SELECT 'symbol:p' || p_partkey, 'P' || p_partkey, 'root', p_partkey % n + 1, p_partkey FROM part, n WHERE p_partkey % 20 = 0),
links AS (SELECT test_path, 'file:s' || (c % n + 1) AS target_id, CASE WHEN c % 2 = 0 THEN 'imports' ELSE 'references' END AS type, 'outgoing_from_test' AS way FROM tests, n WHERE c % 3 = 0
  UNION ALL SELECT test_path, 'file:s' || (c % n + 1), 'calls', 'incoming_to_test' FROM tests, n WHERE c % 33 = 0),
direct AS (SELECT test_path, target_id, 'structural_' || string_agg(DISTINCT type, '_' ORDER BY type) AS rule, string_agg(DISTINCT type, ', ' ORDER BY type) AS types, string_agg(DISTINCT way, ', ' ORDER BY way) AS directions, string_agg(DISTINCT told, '; ' ORDER BY told) AS evidence
  FROM (SELECT l.*, CASE WHEN way = 'outgoing_from_test' THEN test_path || ' -[' || type || ']-> ' || target_name ELSE target_name || ' -[' || type || ']-> ' || test_path END AS told FROM links l JOIN t USING (target_id)) GROUP BY 1, 2),
byfile AS (SELECT test_path, target_id FROM tests JOIN t ON c % 25 = home),
byname AS (SELECT test_path, target_id, min('test_p' || (o_orderkey % 3000) || CASE WHEN o_orderkey % 2 = 0 THEN '_works' ELSE '' END) AS matched
  FROM orders JOIN tests ON c = o_custkey JOIN part ON p_partkey = o_orderkey % 3000, n, t WHERE t.part = p_partkey OR (t.part IS NULL AND t.home = p_partkey % n + 1) GROUP BY 1, 2),
heuristic AS (SELECT test_path, target_id, CASE WHEN f.test_path IS NOT NULL THEN 'naming_convention' ELSE 'symbol_name_match' END AS rule, CASE WHEN f.test_path IS NOT NULL THEN 'named after the target: ' || test_path ELSE 'test of the target''s name: ' || matched END AS evidence
  FROM (SELECT * FROM byfile) f FULL JOIN byname b USING (test_path, target_id) WHERE (test_path, target_id) NOT IN (SELECT (test_path, target_id) FROM direct)),
found AS (SELECT test_path, target_id, rule, types, directions, evidence, 'direct' AS classification, 'high' AS confidence FROM direct UNION ALL SELECT test_path, target_id, rule, NULL, NULL, evidence, 'heuristic', 'medium' FROM heuristic),
met AS (SELECT target_id, target_name, target_kind, test_path, coalesce(rule, 'unassociated') AS rule, types, directions, evidence, coalesce(classification, 'unknown') AS classification, coalesce(confidence, 'none') AS confidence FROM t LEFT JOIN found USING (target_id))
"""


@query("test_associations", _MET + "SELECT * FROM met")
def test_associations(spark, d):
    """Direct and heuristic tests of files and symbols with their evidence, and targets without any."""
    return assurance.associations(*_tested(spark, d))


@query(
    "verification_checklist",
    _MET
    + f""", lv AS (SELECT *, CASE classification WHEN 'direct' THEN 0 ELSE 1 END AS level, min(CASE classification WHEN 'direct' THEN 0 ELSE 1 END) OVER (PARTITION BY test_path) AS least FROM met WHERE test_path IS NOT NULL),
names AS (SELECT test_path, least, target_name, row_number() OVER (PARTITION BY test_path ORDER BY target_name) AS r, count(*) OVER (PARTITION BY test_path) AS n FROM (SELECT DISTINCT test_path, least, target_name FROM lv WHERE level = least)),
each_ AS (SELECT test_path, least, max(n) AS n, string_agg(target_name, ',' ORDER BY r) FILTER (r <= {SHOWN}) AS targets FROM names GROUP BY 1, 2),
alone AS (SELECT DISTINCT target_name, target_kind FROM met WHERE classification = 'unknown'),
every AS (SELECT target_name, row_number() OVER (ORDER BY target_name) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT target_name FROM lv)),
lone AS (SELECT target_name, row_number() OVER (ORDER BY target_name) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT target_name FROM alone)),
asked AS (SELECT n_name AS path, CASE WHEN n_nationkey % 5 = 0 THEN 'not_found' ELSE 'outside_root' END AS status FROM nation WHERE n_nationkey % 3 <> 0),
items AS (SELECT CASE least WHEN 0 THEN 'detected_structural' ELSE 'heuristic_recommendation' END AS category, CASE least WHEN 0 THEN 'structural:' ELSE 'heuristic:' END || test_path AS item_id, CASE least WHEN 0 THEN 'direct' ELSE 'heuristic' END AS classification, test_path, n AS n_targets, targets, 'pytest ' || test_path AS command FROM each_
UNION ALL SELECT 'additional_verification', 'missing_test:' || target_name, 'suggested', NULL, 1, target_name, NULL FROM alone WHERE target_kind = 'root'
UNION ALL SELECT 'additional_verification', 'consolidated_test_run', 'suggested', NULL, max(n), string_agg(target_name, ',' ORDER BY r) FILTER (r <= {SHOWN}), NULL FROM every HAVING (SELECT count(DISTINCT test_path) FROM lv) >= 2
UNION ALL SELECT 'unverified_area', 'unresolved_path:' || path, 'unknown', NULL, 1, path, NULL FROM asked
UNION ALL SELECT 'unverified_area', 'incomplete_analysis', 'unknown', NULL, 0, '', NULL UNION ALL SELECT 'unverified_area', 'stale_freshness', 'unknown', NULL, 0, '', NULL
UNION ALL SELECT 'unverified_area', 'unassociated_targets', 'unknown', NULL, max(n), string_agg(target_name, ',' ORDER BY r) FILTER (r <= {SHOWN}), NULL FROM lone HAVING count(*) > 0)
SELECT CASE category WHEN 'detected_structural' THEN 1 WHEN 'heuristic_recommendation' THEN 2 WHEN 'additional_verification' THEN 3 ELSE 4 END AS rank, * FROM items""",
)
def verification_checklist(spark, d):
    """What to run and to look at, with an incomplete, stale analysis and paths that weren't resolved."""
    met = checkpoint(assurance.associations(*_tested(spark, d)))
    nation = table(spark, d, "nation")
    asked = nation.select(F.col("n_name").alias("path"), F.when(F.col("n_nationkey") % 3 == 0, "resolved").when(F.col("n_nationkey") % 5 == 0, "not_found").otherwise("outside_root").alias("status"))
    items = assurance.checklist(met, asked, "partial", 2, "stale", SHOWN)
    return items.select("rank", "category", "item_id", "classification", "test_path", "n_targets", F.array_join("targets", ",").alias("targets"), "command")


_HIT = """, hit AS (SELECT node, min(depth) AS depth, node IN (SELECT id FROM files WHERE s_suppkey IN (1, 2)) AS own FROM near WHERE depth > 0 GROUP BY node),
roots AS (SELECT id, name, path FROM files WHERE s_suppkey IN (1, 2)), reached AS (SELECT node, depth, own, name, path FROM hit JOIN vertices v ON v.id = node),
touched AS (SELECT path FROM roots UNION SELECT path FROM reached), home AS (SELECT v.id, v.path, f.directory_id[5:] AS package FROM vertices v JOIN files f ON f.id = v.file_id),
cross_ AS (SELECT DISTINCT a.package AS source_package, b.package AS target_package, a.path AS source_path, b.path AS target_path FROM edges e JOIN home a ON a.id = source_id JOIN home b ON b.id = target_id WHERE a.package <> b.package AND (a.path IN (SELECT path FROM touched) OR b.path IN (SELECT path FROM touched))),
judged AS (SELECT *, source_package LIKE 'EUROPE/%' AND target_package LIKE 'ASIA/%' AS east, target_package LIKE 'AFRICA/%' AS africa, source_package LIKE 'AMERICA/%' AS america FROM cross_),
decided AS (SELECT *, CASE WHEN africa AND (east OR america) THEN 'ambiguous' WHEN africa THEN 'allow' WHEN east OR america THEN 'deny' ELSE 'unrestricted' END AS policy,
  CASE WHEN africa AND america THEN 'from-america,to-africa' WHEN africa THEN 'to-africa' WHEN east THEN 'no-east' WHEN america THEN 'from-america' ELSE '' END AS rule_id FROM judged),
diff AS (SELECT CASE WHEN p_size % 4 = 0 THEN 'added' WHEN p_size % 4 = 1 THEN 'removed' WHEN p_size % 4 = 2 THEN 'modified' ELSE 'moved' END AS change, p_name || '/' || p_partkey AS path, 'old/' || p_partkey AS old_path FROM part),
fact AS (SELECT 'changed_entity' AS category, 'root' AS kind, 'root:' || id AS fact_id, name, path, 'changed: ' || name AS statement, NULL AS policy, NULL AS rule_id FROM roots
UNION ALL SELECT 'affected_component', CASE WHEN depth = 1 AND NOT own THEN 'direct' ELSE 'downstream' END, CASE WHEN depth = 1 AND NOT own THEN 'direct_impact:' ELSE 'downstream:' END || node, name, path, 'affected at depth ' || depth || ': ' || name, NULL, NULL FROM reached
UNION ALL SELECT 'changed_entity', 'comparison', 'comparison:' || change || '_file:' || path, NULL, path, change || ' ' || path || CASE WHEN change = 'moved' THEN ' from ' || old_path ELSE '' END, NULL, NULL FROM diff
UNION ALL SELECT 'changed_entity', 'unresolved', 'unresolved_input:' || n_name, NULL, n_name, 'not resolved: ' || n_name || ' not_found', NULL, NULL FROM nation
UNION ALL SELECT DISTINCT 'test_association', 'untested', 'unassociated_target:' || name, name, NULL, 'no test found for ' || name, NULL, NULL FROM (SELECT name FROM roots UNION SELECT name FROM reached WHERE depth > 1 AND NOT own)
UNION ALL SELECT 'package_boundary', 'crossing', 'pkg_boundary:' || source_package || '->' || target_package || ':' || source_path || '->' || target_path, NULL, source_path, source_package || '->' || target_package || ':' || source_path || '->' || target_path, policy, rule_id FROM decided
UNION ALL SELECT 'freshness_state', 'freshness', 'freshness_state', 'stale', NULL, 'freshness: stale', NULL, NULL UNION ALL SELECT 'analysis_status', 'incomplete', 'analysis_status', 'partial', NULL, 'analysis: partial, errors: 0', NULL, NULL)
"""


def _facts(spark, d):
    g = commerce(spark, d)
    g.status = "partial"
    roots = _root(g).union(_root(g, 2))
    hit = checkpoint(traverse.change_impact(g, roots, 2, "both", ["imports"]))
    of_file = g.files.select("id", F.regexp_replace("directory_id", "^dir:", "").alias("package"))
    size = F.col("p_size") % 4
    change = F.when(size == 0, "added").when(size == 1, "removed").when(size == 2, "modified").otherwise("moved")
    diff = table(spark, d, "part").select(change.alias("change"), F.concat_ws("/", "p_name", "p_partkey").alias("path"), F.concat(F.lit("old/"), F.col("p_partkey").cast("string")).alias("old_path"))
    asked = table(spark, d, "nation").select(F.col("n_name").alias("path"), F.lit("not_found").alias("status"))
    met = checkpoint(assurance.associations(g, assurance.change_targets(roots, hit)))
    return assurance.facts(g, roots, hit, met, of_file=of_file, rules=POLICY, diff=diff, asked=asked, freshness="stale")


def _risk(body: str) -> str:
    return COMMERCE + _closure(_HIT + body, depth=2, both=True)


@query("risk_fact_list", _risk("SELECT category, kind, fact_id, name, path, statement, policy, rule_id FROM fact"))
def risk_fact_list(spark, d):
    """All kinds of facts but the text of paths, which steps of equal length may tell otherwise."""
    return _facts(spark, d).where("kind <> 'path'").select("category", "kind", "fact_id", "name", "path", "statement", "policy", "rule_id")


@query(
    "risk_concern_list",
    _risk("""SELECT CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 3 ELSE 4 END AS severity_rank, severity, category, concern_id, n, string_agg(fact_id, ',' ORDER BY r) FILTER (r <= 10) AS facts, string_agg(statement, '; ' ORDER BY r) FILTER (r <= 5) AS evidence FROM (
SELECT CASE WHEN concern_id = 'broad_downstream_impact' AND n >= 3 THEN 'warning' ELSE severity END AS severity, * EXCLUDE (severity) FROM (SELECT *, row_number() OVER (PARTITION BY concern_id ORDER BY fact_id) AS r, count(*) OVER (PARTITION BY concern_id) AS n FROM (
SELECT 'info' AS severity, 'broad_impact' AS category, 'broad_downstream_impact' AS concern_id, fact_id, statement FROM fact WHERE kind = 'downstream'
UNION ALL SELECT 'warning', 'unverified_area', 'unverified_affected_components', fact_id, statement FROM fact WHERE kind = 'untested'
UNION ALL SELECT 'info', 'cross_package_impact', 'cross_package_propagation', fact_id, statement FROM fact WHERE kind = 'crossing'
UNION ALL SELECT 'error', 'policy_violation', 'policy_violation:' || rule_id, fact_id, statement FROM fact WHERE policy = 'deny'
UNION ALL SELECT 'warning', 'policy_violation', 'ambiguous_package_policy', fact_id, statement FROM fact WHERE policy = 'ambiguous'
UNION ALL SELECT 'warning', 'stale_analysis', 'stale_analysis_risk', fact_id, statement FROM fact WHERE kind = 'freshness'
UNION ALL SELECT 'error', 'incomplete_analysis', 'incomplete_analysis_risk', fact_id, statement FROM fact WHERE kind = 'incomplete'
UNION ALL SELECT 'error', 'unresolved_input', 'unresolved_inputs_risk', fact_id, statement FROM fact WHERE kind = 'unresolved'))) GROUP BY ALL"""),
)
def risk_concern_list(spark, d):
    """Concerns with their counts, the facts they rest on and their statements."""
    found = assurance.concerns(checkpoint(_facts(spark, d)))
    return found.select("severity_rank", "severity", "category", "concern_id", "n", F.array_join("facts", ",").alias("facts"), F.array_join("evidence", "; ").alias("evidence"))


@query(
    "risk_gaps",
    _risk("""SELECT CASE kind WHEN 'untested' THEN 'test_associations' WHEN 'incomplete' THEN 'structural_graph' WHEN 'freshness' THEN 'repository_freshness' ELSE 'input_resolution' END AS category,
CASE kind WHEN 'untested' THEN 'missing_test_associations' WHEN 'incomplete' THEN 'incomplete_analysis_evidence' WHEN 'freshness' THEN 'freshness_uncertainty' ELSE fact_id END AS item_id, count(*) AS n FROM fact WHERE kind IN ('untested', 'incomplete', 'freshness', 'unresolved') GROUP BY ALL"""),
)
def risk_gaps(spark, d):
    """What the facts leave open."""
    return assurance.missing_evidence(_facts(spark, d))


@query(
    "unused_listing",
    """WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'tests/' ELSE '' END || c_name || '.py' AS path, CASE WHEN c_custkey % 2 = 0 THEN 'Test' ELSE '' END || c_name AS name FROM customer),
used AS (SELECT DISTINCT user_id FROM events), i AS (
SELECT 'symbol:c' || k AS id, name, 'class' AS kind, path, 1 AS start_line, CASE WHEN k % 6 = 0 THEN 'cannot_assess' ELSE 'unused_candidate' END AS classification FROM s WHERE k NOT IN (SELECT user_id FROM used)
UNION ALL SELECT 'file:c' || k, split_part(path, '/', -1), 'file', path, NULL, CASE WHEN k % 3 = 0 THEN 'cannot_assess' ELSE 'unused_candidate' END FROM s WHERE k NOT IN (SELECT user_id FROM used))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY classification ORDER BY path, coalesce(start_line, 0), name, kind, id) AS INTEGER) AS position, count(*) OVER (PARTITION BY classification) AS total FROM i) WHERE position <= 7""",
)
def unused_listing(spark, d):
    """What nothing uses, symbols and files, in two lists of their own limit."""
    g = _customers(spark, d)
    k = F.substring_index("id", ":c", -1).cast("int")
    folder = F.when(k % 3 == 0, "tests/").otherwise("")
    g.files = g.files.withColumn("path", F.concat(folder, "path"))
    g.symbols = g.symbols.withColumn("name", F.concat(F.when(k % 2 == 0, "Test").otherwise(""), "name"))
    return usage.listed(usage.unused(g), 7)


_ASKED = """, asked AS (SELECT n_nationkey AS k, n_name AS task, CASE WHEN n_nationkey % 3 = 0 THEN ' SUPPLIER#00000000' || (n_nationkey % 10) WHEN n_nationkey % 3 = 1 THEN 'red widget' ELSE '' END AS target,
  CASE WHEN n_nationkey % 4 = 3 THEN [] ELSE [upper(n_name), 'Green ', 'supplier', 'brand#1', 'rod', ' '] END AS concepts FROM nation),
told AS (SELECT task, k, nullif(lower(trim(target)), '') AS target, [lower(trim(c)) FOR c IN concepts IF trim(c) <> ''] AS concepts FROM asked),
home AS (SELECT fid, s_nationkey FROM keys JOIN supplier USING (s_suppkey)),
f AS (SELECT task, id AS entity_id, t.target, concepts, lower(name || ' ' || path) AS text FROM told t JOIN home ON s_nationkey = k JOIN files ON id = fid),
fm AS (SELECT task, entity_id, target, text, len(concepts) AS size, (SELECT count(*) FROM (SELECT unnest(concepts) AS c, generate_subscripts(concepts, 1) AS at) WHERE contains(text, c) OR EXISTS (SELECT 1 FROM symbols s WHERE s.file_id = entity_id AND contains(lower(s.name), c))) AS n FROM f),
s AS (SELECT task, id AS entity_id, t.target, concepts, list_distinct([lower(name), lower(trim(qualified_name))]) AS names FROM told t JOIN home ON s_nationkey = k JOIN symbols ON file_id = fid),
sm AS (SELECT task, entity_id, target, names, len(concepts) AS size, (SELECT count(*) FROM (SELECT unnest(concepts) AS c), (SELECT unnest(names) AS t) WHERE contains(t, c)) AS n FROM s)
SELECT task, entity_id, round(CASE WHEN target IS NOT NULL AND contains(text, target) THEN 1.0 WHEN size > 0 THEN least(1.0, CAST(n AS DOUBLE) / size) ELSE 0 END, 9) AS relevance FROM fm
UNION ALL SELECT task, entity_id, round(CASE WHEN target IS NOT NULL AND list_contains(names, target) THEN 1.0 WHEN size > 0 THEN least(1.0, CAST(n AS DOUBLE) / size) ELSE 0 END, 9) FROM sm"""


@query("task_relevance", COMMERCE + _ASKED)
def task_relevance(spark, d):
    """Files by name, path and the names of their symbols, symbols by name and qualified name; a task for each nation."""
    g = commerce(spark, d)
    k, none = F.col("n_nationkey"), F.array().cast("array<string>")
    target = F.when(k % 3 == 0, F.concat(F.lit(" SUPPLIER#00000000"), (k % 10).cast("string"))).when(k % 3 == 1, "red widget").otherwise("")
    concepts = F.when(k % 4 == 3, none).otherwise(F.array(F.upper("n_name"), *map(F.lit, ("Green ", "supplier", "brand#1", "rod", " "))))
    asked = table(spark, d, "nation").select(F.col("n_name").alias("task"), target.alias("target"), concepts.alias("concepts"))
    files = g.files.select(F.substring_index(F.regexp_replace("directory_id", "^dir:", ""), "/", -1).alias("task"), F.col("id").alias("file_id"))
    candidates = files.select("task", F.col("file_id").alias("entity_id")).unionByName(files.join(g.symbols.select("file_id", F.col("id").alias("entity_id")), "file_id").select("task", "entity_id"))
    return search.relevance(g, candidates, asked).withColumn("relevance", F.round("relevance", 9))


@query(
    "task_states",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN 'fix ' || o_orderpriority WHEN 2 THEN o_orderpriority ELSE '!?' END AS task, CASE WHEN o_orderkey % 5 = 0 THEN 'several ' || o_orderpriority WHEN o_orderkey % 5 = 1 THEN ' ' END AS ambiguity FROM orders)
SELECT o_orderkey, CASE WHEN trim(task) = '' THEN 'insufficient' WHEN ambiguity > ' ' THEN 'ambiguous' ELSE 'clear' END AS state,
concat_ws('|', CASE WHEN trim(task) = '' THEN 'task is empty|task intent is missing' END, CASE WHEN o_orderkey % 4 IN (0, 3) THEN 'task concepts are missing' END, CASE WHEN o_orderkey % 4 <> 1 THEN 'requested action is missing' END, CASE WHEN ambiguity > ' ' THEN ambiguity END) AS reasons FROM t""",
)
def task_states(spark, d):
    """States of tasks with every reason."""
    k = F.col("o_orderkey")
    task = F.when(k % 4 == 0, "  ").when(k % 4 == 1, F.concat(F.lit("fix "), "o_orderpriority")).when(k % 4 == 2, F.col("o_orderpriority")).otherwise("!?")
    unclear = F.when(k % 5 == 0, F.concat(F.lit("several "), "o_orderpriority")).when(k % 5 == 1, " ")
    rows = table(spark, d, "orders").select("o_orderkey", task.alias("task"), unclear.alias("ambiguity"))
    return tasks.understand(rows).select("o_orderkey", "state", F.array_join("reasons", "|").alias("reasons"))


@query("memory_symbols", COMMERCE + ", hit AS (SELECT s.id, f.path, s.start_line, s.name FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name = 'red widget') SELECT *, CAST(row_number() OVER (ORDER BY path, start_line, name, id) AS INTEGER) AS position FROM hit")
def memory_symbols(spark, d):
    """the symbols of one name, in the order of a listing."""
    return lookup.memory_symbols(commerce(spark, d), "red widget").select("id", "path", "start_line", "name", "position")


@query(
    "selection_metrics",
    """WITH e AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS m FROM lineitem WHERE l_quantity > 25), a AS (SELECT l_suppkey AS k, l_partkey AS m FROM lineitem WHERE l_discount <= 0.05 INTERSECT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_tax <= 0.04),
c AS (SELECT k, count(*) FILTER (x) AS expected, count(*) FILTER (y) AS actual, count(*) FILTER (x AND y) AS matched FROM (SELECT coalesce(e.k, a.k) AS k, e.k IS NOT NULL AS x, a.k IS NOT NULL AS y FROM e FULL JOIN a ON e.k = a.k AND e.m = a.m) GROUP BY 1),
s AS (SELECT *, CASE WHEN actual > 0 THEN matched / CAST(actual AS DOUBLE) WHEN expected = 0 THEN 1 ELSE 0 END AS p, CASE WHEN expected > 0 THEN matched / CAST(expected AS DOUBLE) ELSE 1 END AS r FROM c)
SELECT k AS "case", expected, actual, matched, round(p, 9) AS "precision", round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM s""",
)
def selection_metrics(spark, d):
    """M4: what was selected among the candidates against what was expected, by case."""
    item = table(spark, d, "lineitem")
    members = lambda when: item.where(when).select(F.col("l_suppkey").alias("case"), F.col("l_partkey").alias("member"))
    counts = metrics.selection_counts(members("l_quantity > 25"), members("l_discount <= 0.05"), members("l_tax <= 0.04"), ["case"])
    return metrics.scores(counts).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "state_validation",
    """WITH p AS (SELECT o_orderkey AS k, o_custkey % 50 AS br, CASE WHEN o_orderkey % 13 = 0 THEN o_custkey % 50 + 1 WHEN o_orderkey % 17 <> 0 THEN o_custkey % 50 END AS ar,
  CASE WHEN o_orderkey % 19 <> 0 THEN CASE o_orderstatus WHEN 'O' THEN 'analyzed' WHEN 'F' THEN 'completed' ELSE 'partial' END END AS bs, CASE WHEN o_orderkey % 23 <> 0 THEN 'analyzed' END AS av, o_orderkey % 11 = 0 AS ae,
  CASE o_orderkey % 7 WHEN 0 THEN 'stale' WHEN 1 THEN 'indeterminate' WHEN 2 THEN 'current' END AS bf, CASE o_orderkey % 9 WHEN 0 THEN 'stale' WHEN 1 THEN 'incomplete' END AS af, o_orderkey % 2 = 0 AS h FROM orders),
r AS (SELECT *, CASE WHEN bs IS NULL THEN 'missing_before_state' WHEN av IS NULL THEN 'missing_after_state' WHEN br <> ar THEN 'repository_mismatch' ELSE 'valid' END AS reason, bs IN ('analyzed', 'completed') AS bw, NOT ae AS aw FROM p),
c AS (SELECT *, CASE WHEN reason <> 'valid' THEN 'blocker:' || upper(reason) ELSE concat_ws(',', CASE WHEN NOT bw THEN 'warning:INCOMPLETE_BEFORE_STATE' END, CASE WHEN NOT aw THEN 'warning:INCOMPLETE_AFTER_STATE' END,
  CASE WHEN bf = 'indeterminate' THEN 'warning:INDETERMINATE_FRESHNESS' WHEN bf = 'stale' AND NOT h THEN 'warning:STALE_STATE' END, CASE WHEN af = 'incomplete' THEN 'warning:INCOMPLETE_FRESHNESS' WHEN af = 'stale' THEN 'warning:STALE_STATE' END) END AS codes FROM r)
SELECT k AS o_orderkey, reason, reason = 'valid' AND bw AND aw AS is_complete, codes, CASE WHEN reason <> 'valid' THEN 'blocked' WHEN NOT (bw AND aw) THEN 'incomplete' WHEN codes <> '' THEN 'partial' ELSE 'success' END AS outcome FROM c""",
)
def state_validation(spark, d):
    """Pairs of states, one for each order."""
    k, repository = F.col("o_orderkey"), F.col("o_custkey") % 50
    status = F.when(F.col("o_orderstatus") == "O", "analyzed").when(F.col("o_orderstatus") == "F", "completed").otherwise("partial")
    pairs = table(spark, d, "orders").select(
        "o_orderkey", repository.alias("before_repository"), F.when(k % 13 == 0, repository + 1).when(k % 17 != 0, repository).alias("after_repository"), F.when(k % 19 != 0, status).alias("before_status"), F.when(k % 23 != 0, "analyzed").alias("after_status"),
        F.lit(0).alias("before_errors"), F.when(k % 11 == 0, 3).alias("after_errors"), F.when(k % 7 == 0, "stale").when(k % 7 == 1, "indeterminate").when(k % 7 == 2, "current").alias("before_freshness"),
        F.when(k % 9 == 0, "stale").when(k % 9 == 1, "incomplete").alias("after_freshness"), (k % 2 == 0).alias("before_historical"), F.lit(None).cast("boolean").alias("after_historical"),
    )
    codes = F.array_join(F.transform("codes", lambda c: F.concat(c["severity"], F.lit(":"), c["code"])), ",")
    return changes.validate_pairs(pairs).select("o_orderkey", "reason", "is_complete", codes.alias("codes"), "outcome")


@query(
    "test_predicates",
    """WITH p AS (SELECT p_partkey, p_size, CASE p_size % 6 WHEN 0 THEN 'Tests/' WHEN 1 THEN 'a/test/' WHEN 2 THEN 'contest/' ELSE '' END || CASE p_partkey % 5 WHEN 0 THEN 'Test_' ELSE 'x' END || p_partkey || CASE p_partkey % 7 WHEN 0 THEN '_test' WHEN 1 THEN '_TEST.py' WHEN 2 THEN '_test.js' ELSE '.py' END AS path FROM part),
q AS (SELECT *, p_partkey % 5 = 0 OR p_partkey % 7 = 1 AS named, p_size % 6 < 2 AS placed FROM p)
SELECT p_partkey, named OR placed AS changeset, named AS runner, p_size % 10 = 9 OR named OR placed OR p_partkey % 7 = 0 AS verification, CASE p_partkey % 7 WHEN 0 THEN 'unknown' WHEN 2 THEN 'javascript' ELSE 'python' END AS language FROM q""",
)
def test_predicates(spark, d):
    """Three predicates of test files, and the parser's language by extension."""
    k, size = F.col("p_partkey"), F.col("p_size") % 6
    folder = F.when(size == 0, "Tests/").when(size == 1, "a/test/").when(size == 2, "contest/").otherwise("")
    ending = F.when(k % 7 == 0, "_test").when(k % 7 == 1, "_TEST.py").when(k % 7 == 2, "_test.js").otherwise(".py")
    rows = table(spark, d, "part").select("p_partkey", F.concat(folder, F.when(k % 5 == 0, "Test_").otherwise("x"), k.cast("string"), ending).alias("path"), F.when(F.col("p_size") % 10 == 9, "test").otherwise("source").alias("file_type"))
    name = F.substring_index("path", "/", -1)
    language = F.coalesce(classify.parser_language(F.col("path")), F.lit("unknown"))
    return rows.select("p_partkey", usage.is_changeset_test(F.col("path")).alias("changeset"), usage.is_runner_file(name).alias("runner"), usage.is_verification_test().alias("verification"), language.alias("language"))
