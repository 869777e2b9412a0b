"""The driver's tables as property graphs, and the same views in SQL for the oracle.

Commerce graph: region and nation are directories, supplier a file, part a symbol of the
supplier with the least key that sells it; ``references`` are the (supplier, part) pairs of
lineitem, ``imports`` lead from a supplier to the one that a large undiscounted item names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Graph, directory_id, edge_id, file_id
from ..session import few, table


def commerce(spark: SparkSession, sf_dir: str) -> Graph:
    region, nation, supplier, part, item = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "part", "lineitem"))
    null = F.lit(None).cast("string")
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name", F.concat_ws("/", "r_name", "n_name").alias("path"))
    directories = region.select(directory_id(F.col("r_name")).alias("id"), F.col("r_name").alias("path"), F.col("r_name").alias("name"), null.alias("parent_id"), F.lit(1).alias("depth"), F.lit("source").alias("directory_type")).unionByName(
        places.select(directory_id(F.col("path")).alias("id"), "path", F.col("n_name").alias("name"), directory_id(F.col("r_name")).alias("parent_id"), F.lit(2).alias("depth"), F.lit("source").alias("directory_type"))
    )
    located = supplier.join(F.broadcast(places), supplier.s_nationkey == places.n_nationkey).withColumn("file_path", F.concat_ws("/", "path", "s_name"))
    files = located.select(file_id(F.col("file_path")).alias("id"), directory_id(F.col("path")).alias("directory_id"), F.col("file_path").alias("path"), F.col("s_name").alias("name"), F.lit("").alias("extension"), F.lit("source").alias("file_type"), F.col("s_acctbal").cast("bigint").alias("size"), F.lit(False).alias("is_generated"), F.lit(False).alias("is_ignored"))
    n = supplier.count()
    keys = located.select(F.col("s_suppkey"), file_id(F.col("file_path")).alias("fid"))
    homes = item.groupBy("l_partkey").agg(F.min("l_suppkey").alias("s_suppkey")).join(keys, "s_suppkey")
    symbols = part.join(homes, part.p_partkey == homes.l_partkey).select(
        F.concat(F.lit("symbol:"), F.col("p_partkey").cast("string")).alias("id"), F.col("fid").alias("file_id"), F.col("p_name").alias("name"), F.lower("p_type").alias("kind"),
        F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.col("p_size").alias("start_line"), (F.col("p_size") + 10).alias("end_line"), null.alias("parent_symbol_id"), F.col("p_type").alias("signature"),
    )
    sold = item.groupBy("l_suppkey", "l_partkey").agg(F.min("l_linenumber").alias("line"), F.min("l_discount").alias("d")).join(few(keys, n), F.col("l_suppkey") == F.col("s_suppkey"))
    symbol_of = F.concat(F.lit("symbol:"), F.col("l_partkey").cast("string"))
    reference = sold.select(F.col("fid").alias("source_id"), symbol_of.alias("target_id"), F.lit("references").alias("relationship_type"), F.round(1 - F.col("d"), 2).alias("confidence"), F.col("line"))
    big = item.where((F.col("l_quantity") >= 49) & (F.col("l_discount") <= 0.01)).groupBy("l_suppkey", (F.col("l_partkey") % n).alias("to")).agg(F.min("l_linenumber").alias("line"))
    other = keys.select(F.col("s_suppkey").alias("to"), F.col("fid").alias("target_id"))
    imported = big.join(keys, F.col("l_suppkey") == F.col("s_suppkey")).join(other, "to").select(F.col("fid").alias("source_id"), "target_id", F.lit("imports").alias("relationship_type"), F.lit(1.0).alias("confidence"), "line")
    defined = symbols.select(F.col("file_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("defines").alias("relationship_type"), F.lit(1.0).alias("confidence"), F.col("start_line").alias("line"))
    edges = reference.unionByName(imported).unionByName(defined)
    edges = edges.select(edge_id(F.col("source_id"), F.col("target_id"), F.col("relationship_type")).alias("id"), "source_id", "target_id", "relationship_type", "confidence", F.create_map(F.lit("line"), F.col("line").cast("string")).alias("metadata"))
    return Graph(directories, files, symbols, edges)


#: The commerce graph in SQL: directories, files, symbols, edges (line in place of metadata) and vertices.
COMMERCE = """WITH RECURSIVE
places AS (SELECT n_nationkey, n_name, r_name, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey),
directories AS (SELECT 'dir:' || r_name AS id, r_name AS path, r_name AS name, CAST(NULL AS VARCHAR) AS parent_id, 1 AS depth FROM region
  UNION ALL SELECT 'dir:' || path, path, n_name, 'dir:' || r_name, 2 FROM places),
keys AS (SELECT s_suppkey, 'file:' || path || '/' || s_name AS fid, path AS dir, s_name, s_acctbal FROM supplier JOIN places ON s_nationkey = n_nationkey),
files AS (SELECT fid AS id, 'dir:' || dir AS directory_id, dir || '/' || s_name AS path, s_name AS name, CAST(trunc(s_acctbal) AS BIGINT) AS size, s_suppkey FROM keys),
symbols AS (SELECT 'symbol:' || p_partkey AS id, fid AS file_id, p_name AS name, lower(p_type) AS kind, p_brand || '.' || p_name AS qualified_name, p_size AS start_line, p_size + 10 AS end_line, p_type AS signature, p_partkey
  FROM part JOIN (SELECT l_partkey, min(l_suppkey) AS k FROM lineitem GROUP BY 1) ON p_partkey = l_partkey JOIN keys ON k = s_suppkey),
raw_edges AS (
  SELECT fid AS source_id, 'symbol:' || l_partkey AS target_id, 'references' AS relationship_type, round(1 - d, 2) AS confidence, line FROM (SELECT l_suppkey, l_partkey, min(l_linenumber) AS line, min(l_discount) AS d FROM lineitem GROUP BY 1, 2) JOIN keys ON l_suppkey = s_suppkey
  UNION ALL SELECT a.fid, b.fid, 'imports', 1.0, line FROM (SELECT l_suppkey, l_partkey % (SELECT count(*) FROM supplier) AS t, min(l_linenumber) AS line FROM lineitem WHERE l_quantity >= 49 AND l_discount <= 0.01 GROUP BY 1, 2) JOIN keys a ON l_suppkey = a.s_suppkey JOIN keys b ON t = b.s_suppkey
  UNION ALL SELECT file_id, id, 'defines', 1.0, start_line FROM symbols),
edges AS (SELECT md5(source_id || '|' || target_id || '|' || relationship_type) AS id, source_id, target_id, relationship_type, confidence, line FROM raw_edges),
vertices AS (SELECT id, 'file' AS kind, name, path, CAST(NULL AS VARCHAR) AS qualified_name, id AS file_id FROM files
  UNION ALL SELECT s.id, 'symbol', s.name, f.path, s.qualified_name, s.file_id FROM symbols s JOIN files f ON s.file_id = f.id
  UNION ALL SELECT id, 'directory', name, path, NULL, NULL FROM directories)
"""


def web(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages as files (page_id, host, path, module) and their links as imports (page_id, ordinal, href)."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/?([^?#]*)", 1)
    files = pages.select("page_id", host.alias("host"), path.alias("path"))
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ordinal", "href"))
    return files, links


WEB = """WITH RECURSIVE web_files AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1) AS path FROM pages),
web_links AS (SELECT page_id, generate_subscripts(h, 1) - 1 AS ordinal, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))
"""
