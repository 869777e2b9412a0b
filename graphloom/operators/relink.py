"""Incremental linking: only files whose links can have changed are linked again.

Two tables are kept beside the graph. ``names`` counts the symbols of every name; ``referrers`` has, for every
file, the names and modules on which its links hang. A refresh takes the symbols that went and
came, updates the counts of their names, and looks which names now resolve otherwise: to another
symbol, or where there was one, none or several. The files that refer to these names, to modules
that came or went, and the changed files themselves are linked again; all other edges stay. A name of
thousands of symbols that gains one more concerns nobody.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import Graph
from ..session import checkpoint
from . import link

NAME = ["scope", "by", "key"]


def referrers(files: DataFrame, imports: DataFrame, references: DataFrame, inheritance: DataFrame) -> DataFrame:
    """(file_id, scope, by, key): the names, and by scope ``module`` the modules, on which a file's links hang."""

    def of(rows: DataFrame, scope: str, by: str, key: str) -> DataFrame:
        return rows.select("file_id", F.lit(scope).alias("scope"), F.lit(by).alias("by"), F.col(key).alias("key"))

    bound, targets = link.bindings(imports), link.import_targets(files, imports)
    parts = [of(rows, scope, by, by) for rows, scope in ((references, "symbol"), (inheritance, "class")) for by in ("name", "qualified_name")]
    parts += [of(bound, scope, by, key) for scope in ("symbol", "class") for by, key in (("qualified_name", "full"), ("name", "bare"))]
    parts += [of(targets, "module", "name", key) for key in ("m1", "m2")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("key is not null").distinct()


def indexed(graph: Graph) -> Graph:
    """``graph`` with the two tables, built anew."""
    return Graph(
        graph.directories, graph.files, graph.symbols, graph.edges, graph.imports, graph.references, graph.inheritance, graph.errors, graph.status,
        link.count_names(graph.symbols), referrers(graph.files, graph.imports, graph.references, graph.inheritance),
    )


def _changed_names(before: Graph, after: Graph, at: DataFrame) -> DataFrame:
    """(scope, by, key, was, was_id, n, id) of all names of symbols that went or came with the files ``at`` (file_id)."""
    went = link.named(before.symbols.join(at, "file_id", "left_semi")).withColumn("sign", F.lit(-1))
    came = link.named(after.symbols.join(at, "file_id", "left_semi")).withColumn("sign", F.lit(1))
    net = went.unionByName(came).groupBy(*NAME, "id").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    touched = checkpoint(net.groupBy(*NAME).agg(F.sum("sign").alias("more")))
    counted = touched.join(before.names.select(*NAME, F.col("n").alias("was"), F.col("id").alias("was_id")), NAME, "left")
    counted = counted.select(*NAME, F.coalesce("was", F.lit(0)).alias("was"), "was_id", (F.coalesce("was", F.lit(0)) + F.col("more")).alias("n"))
    # Which symbol is the only one is looked up for these names alone.
    only = link.named(after.symbols).join(counted.where("n = 1").select(*NAME), NAME).groupBy(*NAME).agg(F.min("id").alias("id"))
    return checkpoint(counted.join(only, NAME, "left"))


def _resolves(n: str, to: str) -> Column:
    """What the ladders see of a name: none, one symbol, or several."""
    return F.struct(F.least(F.col(n), F.lit(2)).alias("n"), F.col(to).alias("id"))


def relink(before: Graph, after: Graph, changed: DataFrame, relinked: Observation | None = None) -> Graph:
    """``after``, the tables once the files ``changed`` (path) have been replaced, with the edges, names and referrers that belong to it.

    ``before`` has its edges and both tables. ``relinked`` observes, as ``references``, how many are resolved again.
    """
    paths_at = changed.select("path").distinct()
    at = checkpoint(paths_at.select(F.concat(F.lit("file:"), "path").alias("file_id")))
    names = _changed_names(before, after, at)
    turned = names.where(~_resolves("was", "was_id").eqNullSafe(_resolves("n", "id"))).select(*NAME)
    old, new = (g.files.join(paths_at, "path", "left_semi").select("path") for g in (before, after))
    moved = old.exceptAll(new).unionByName(new.exceptAll(old)).select(F.lit("module").alias("scope"), F.lit("name").alias("by"), paths.build_module(F.col("path")).alias("key"))
    kept = before.referrers.join(at, "file_id", "left_anti")
    hit = kept.join(turned.unionByName(moved).distinct(), NAME, "left_semi").select("file_id")
    again = checkpoint(hit.unionByName(at).distinct())
    of = lambda df, ids=again: df.join(ids, "file_id", "left_semi")
    counts = before.names.join(names.select(*NAME), NAME, "left_anti").select(*NAME, "n", "id").unionByName(names.where("n > 0").select(*NAME, "n", "id"))
    symbols, imports, references = of(after.symbols), of(after.imports), of(after.references)
    if relinked is not None:
        references = references.observe(relinked, F.count(F.lit(1)).alias("references"))
    part = Graph(after.directories, after.files, symbols, after.edges, imports, references, of(after.inheritance))
    gone = again.select(F.col("file_id").alias("source_id")).unionByName(of(before.symbols).select(F.col("id").alias("source_id")))
    edges = before.edges.join(gone, "source_id", "left_anti").select(before.edges.columns).unionByName(link.build_edges(part, counts))
    fresh = referrers(after.files, of(after.imports, at), of(after.references, at), of(after.inheritance, at))
    return Graph(after.directories, after.files, after.symbols, edges, after.imports, after.references, after.inheritance, after.errors, after.status, counts, kept.select(fresh.columns).unionByName(fresh))
