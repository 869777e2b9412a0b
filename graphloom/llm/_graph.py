"""Connected components of edge tables, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpoint, release


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end of ``edges`` (u, v) has one edge and is nobody's smaller end."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    wrong = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
    return wrong.isEmpty()


def with_roots(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``links`` (a, b) and, as links, the ``roots`` (node, root) of earlier ones."""
    return links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the component's smallest node.

    Large stars and small stars in turn: each round every node hands its larger, then its
    smaller neighbours to the smallest one that it knows, until all edges are stars around the
    smallest nodes. Rounds are checkpointed. A node with many neighbours costs no more
    than its edges, and joins on it can be split. Edges that are stars already take no round, so
    earlier roots (node, root) stand for the edges that they came from.
    """
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    release(now.sparkSession)
    while not _stars(now):
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = checkpoint(small)
        del both, least, large, small
        release(now.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
