"""Queries that parse: sources made from the driver's tables, so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import link, relink
from ..schema import Graph
from ..session import checkpoint, table
from ..sources import parse
from ..streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _sources(spark, d, rows: str = "true"):
    """A module for each part: an import of the next one, a class with a method, and a call; every 50th has a syntax error."""
    k = F.col("p_partkey")
    n = table(spark, d, "part").count()
    text = F.format_string("from m%d import C%d as Base\nimport os.path\nLIMIT = %d\n\nclass C%d(Base):\n    size: int = %d\n\n    async def area(self, x: int, *rest, scale=2, **more):\n        return LIMIT * x\n\ndef make_%d(kind='%s'):\n    return C%d().area(1)\n%s", (k + 1) % n, (k + 1) % n, F.col("p_size"), k, F.col("p_size"), k, F.col("p_type"), k, F.when(k % 50 == 49, "def broken(:\n").otherwise(""))
    path = F.format_string("src/m%d.py", k)
    return table(spark, d, "part").where(rows).select(F.concat(F.lit("file:"), path).alias("id"), path.alias("path"), text.alias("content"))


@query("parsed_symbols", """WITH p AS (SELECT 'file:src/m' || p_partkey || '.py' AS file_id, p_partkey AS k, (p_partkey + 1) % (SELECT count(*) FROM part) AS n, p_type FROM part WHERE p_partkey % 50 <> 49)
SELECT file_id, 'Base' AS name, 'import' AS kind, 'm' || n || '.C' || n AS qualified_name, 1 AS start_line, CAST(NULL AS VARCHAR) AS signature FROM p
UNION ALL SELECT file_id, 'os.path', 'import', 'os.path', 2, NULL FROM p UNION ALL SELECT file_id, 'LIMIT', 'constant', 'LIMIT', 3, NULL FROM p
UNION ALL SELECT file_id, 'C' || k, 'class', 'C' || k, 5, NULL FROM p UNION ALL SELECT file_id, 'size', 'variable', 'C' || k || '.size', 6, NULL FROM p
UNION ALL SELECT file_id, 'area', 'method', 'C' || k || '.area', 8, 'area(self, x: int, *rest, scale = 2, **more)' FROM p
UNION ALL SELECT file_id, 'make_' || k, 'function', 'make_' || k, 11, 'make_' || k || '(kind = ''' || p_type || ''')' FROM p""")
def parsed_symbols(spark, d):
    return parse.tables(parse.parse_files(_sources(spark, d)))["symbols"].select("file_id", "name", "kind", "qualified_name", "start_line", "signature")


@query("parsed_imports", """WITH p AS (SELECT 'file:src/m' || p_partkey || '.py' AS file_id, (p_partkey + 1) % (SELECT count(*) FROM part) AS n FROM part WHERE p_partkey % 50 <> 49)
SELECT file_id, 'm' || n AS module_name, 'C' || n AS imported_name, 'Base' AS alias, 0 AS level FROM p UNION ALL SELECT file_id, 'os.path', NULL, NULL, 0 FROM p""")
def parsed_imports(spark, d):
    return parse.tables(parse.parse_files(_sources(spark, d)))["imports"].drop("ordinal")


@query("parsed_errors", "SELECT 'src/m' || p_partkey || '.py' AS path, count(*) AS errors FROM part WHERE p_partkey % 50 = 49 GROUP BY 1")
def parsed_errors(spark, d):
    errors = parse.tables(parse.parse_files(_sources(spark, d)))["errors"]
    return errors.groupBy(F.regexp_extract("message", "^([^:]+):", 1).alias("path")).agg(F.count("*").alias("errors"))


def _graph(spark, sources) -> Graph:
    parts = parse.tables(checkpoint(parse.parse_files(sources)))
    null = F.lit(None).cast("string")
    files = sources.select("id", F.lit("dir:src").alias("directory_id"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(".py").alias("extension"), F.lit("source").alias("file_type"), F.octet_length("content").cast("bigint").alias("size"), F.lit(False).alias("is_generated"), F.lit(False).alias("is_ignored"))
    directories = spark.range(1).select(F.lit("dir:src").alias("id"), F.lit("src").alias("path"), F.lit("src").alias("name"), null.alias("parent_id"), F.lit(1).alias("depth"), F.lit("source").alias("directory_type"))
    g = Graph(directories, files, parts["symbols"], parts["symbols"].limit(0), parts["imports"], parts["references"], parts["inheritance"], parts["errors"])
    g.edges = link.build_edges(g)
    return g


def _counts(g):
    return g.edges.groupBy("relationship_type", "confidence").agg(F.count("*").alias("edges"))


_LINKED = """WITH p AS (SELECT p_partkey AS k, (p_partkey + 1) % (SELECT count(*) FROM part) AS n FROM part), ok AS (SELECT * FROM p WHERE k % 50 <> 49)
SELECT 'defines' AS relationship_type, CAST(1.0 AS DOUBLE) AS confidence, count(*) * 7 AS edges FROM ok UNION ALL SELECT 'contains', 1.0, count(*) * 2 FROM ok UNION ALL SELECT 'imports', 1.0, count(*) FROM ok
UNION ALL SELECT 'inherits', 0.9, count(*) FROM ok WHERE n % 50 <> 49 UNION ALL SELECT 'references', 0.9, count(*) FROM ok WHERE n % 50 <> 49 UNION ALL SELECT 'references', 0.8, count(*) * 2 FROM ok"""


@query("linked_edges", _LINKED)
def linked_edges(spark, d):
    return _counts(_graph(spark, _sources(spark, d)))


@query("linked_imports", "SELECT 'file:src/m' || p_partkey || '.py' AS source_id, 'file:src/m' || (p_partkey + 1) % (SELECT count(*) FROM part) || '.py' AS target_id FROM part WHERE p_partkey % 50 <> 49")
def linked_imports(spark, d):
    return _graph(spark, _sources(spark, d)).edges.where("relationship_type = 'imports'").select("source_id", "target_id")


@query("linked_inheritance", "WITH p AS (SELECT p_partkey AS k, (p_partkey + 1) % (SELECT count(*) FROM part) AS n FROM part) SELECT 'symbol:src/m' || k || '.py:class:C' || k || ':5:0' AS source_id, 'symbol:src/m' || n || '.py:class:C' || n || ':5:0' AS target_id, CAST(0.9 AS DOUBLE) AS confidence FROM p WHERE k % 50 <> 49 AND n % 50 <> 49")
def linked_inheritance(spark, d):
    return _graph(spark, _sources(spark, d)).edges.where("relationship_type = 'inherits'").select("source_id", "target_id", "confidence")


@query("incremental_refresh", "WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 50 <> 49 AND p_partkey % 7 <> 3) SELECT 'src/m' || k || '.py' AS path, count(*) * 7 AS symbols FROM p GROUP BY k")
def incremental_refresh(spark, d):
    """Some files come, some change back, some go: what is left has the symbols of a full parse."""
    base = _graph(spark, _sources(spark, d, "p_partkey % 5 <> 1"))
    versions = _sources(spark, d, "p_partkey % 5 = 1 or p_partkey % 7 = 3").select("path", F.when(~F.regexp_extract("path", r"m(\d+)", 1).cast("int").__mod__(7).eqNullSafe(3), F.col("content")).alias("content"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    after = incremental.apply_versions(base, versions)
    return after.symbols.join(after.files.select(F.col("id").alias("file_id"), "path"), "file_id").groupBy("path").agg(F.count("*").alias("symbols"))


def _linked_sources(spark, d, rows: str = "true", named: str = "C"):
    """A module for each part: a base class from the next one, a function that two modules share by name, and a use of the next pair's."""
    k = F.col("p_partkey")
    n = table(spark, d, "part").count()
    pairs = (n + 1) // 2
    half = F.floor(k / 2).cast("int")
    text = F.format_string("from m%d import C%d as Base\n\nclass " + named + "%d(Base):\n    pass\n\ndef shared_%d():\n    return 1\n\nuse = shared_%d\n", (k + 1) % n, (k + 1) % n, k, half, (half + 1) % pairs)
    path = F.format_string("src/m%d.py", k)
    return table(spark, d, "part").where(rows).select(F.concat(F.lit("file:"), path).alias("id"), path.alias("path"), text.alias("content"))


_RELINKED = """WITH t AS (SELECT count(*) AS n, (count(*) + 1) // 2 AS pairs FROM part),
p AS (SELECT p_partkey AS k, 'file:src/m' || p_partkey || '.py' AS f, (p_partkey + 1) % n AS nx, (p_partkey // 2 + 1) % pairs AS pair FROM part, t WHERE p_partkey % 7 <> 3),
c AS (SELECT k, 'symbol:src/m' || k || '.py:class:' || CASE WHEN k % 5 = 1 THEN 'D' ELSE 'C' END || k || ':3:0' AS id, k % 5 <> 1 AS kept FROM p),
one AS (SELECT k // 2 AS pair, min('symbol:src/m' || k || '.py:function:shared_' || k // 2 || ':6:0') AS id FROM p GROUP BY 1 HAVING count(*) = 1)
SELECT 'imports' AS relationship_type, p.f AS source_id, q.f AS target_id, CAST(1.0 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS line FROM p JOIN p q ON q.k = p.nx WHERE p.k <> q.k
UNION ALL SELECT 'inherits', c.id, b.id, 0.9, '3' FROM p JOIN c USING (k) JOIN c b ON b.k = p.nx AND b.kept
UNION ALL SELECT 'references', p.f, b.id, 0.9, '3' FROM p JOIN c b ON b.k = p.nx AND b.kept
UNION ALL SELECT 'references', p.f, one.id, 0.7, '9' FROM p JOIN one USING (pair)"""


@query("relinked_edges", _RELINKED)
def relinked_edges(spark, d):
    """Files go (names of two symbols become unique), classes are renamed (names lose their symbol), the rest is left: the edges between files are those of a full build."""
    base = relink.indexed(_graph(spark, _linked_sources(spark, d)))
    gone = _linked_sources(spark, d, "p_partkey % 7 = 3").withColumn("content", F.lit(None).cast("string"))
    renamed = _linked_sources(spark, d, "p_partkey % 5 = 1 and p_partkey % 7 <> 3", "D")
    after = incremental.apply_versions(base, gone.unionByName(renamed).select("path", "content", F.lit("2024-01-02").cast("timestamp").alias("at")))
    return after.edges.where("relationship_type in ('imports', 'inherits', 'references')").select("relationship_type", "source_id", "target_id", "confidence", F.try_element_at("metadata", F.lit("line")).alias("line"))
