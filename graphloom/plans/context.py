"""Ranked retrieval for a task: from its sentence to a budgeted package of units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tasks
from ..operators import search, traverse, units
from ..schema import CONTEXT_UNITS, Graph
from ..session import checkpoint


def candidates(graph: Graph, task: str, changes: DataFrame | None = None) -> DataFrame:
    """Ranked candidates of a task: search, what its words name, what it is grounded in and what lies next to that."""
    spark = graph.files.sparkSession
    sentence = spark.createDataFrame([(task,)], "task string")
    known = tasks.understand(sentence)
    grounded = tasks.ground(tasks.references(sentence), graph.files, graph.symbols).where("status = 'grounded'")
    kinds = graph.vertices().select(F.col("id").alias("entity_id"), F.col("kind").alias("entity_type"), "name", F.coalesce("path", F.lit("")).alias("path"), "qualified_name")
    part = lambda ids, score, source: ids.join(kinds.select("entity_id", "entity_type"), "entity_id").select("entity_id", "entity_type", F.lit(score).alias("score"), F.lit(source).alias("source"))
    found = search.search(graph, task).select("entity_id", "entity_type", "score", F.lit("deterministic_search").alias("source")) if task.strip() else part(grounded.select("entity_id").limit(0), 0.0, "deterministic_search")
    words = known.select(F.explode(F.concat("concepts", F.filter(F.array("target"), lambda t: t.isNotNull()))).alias("name")).distinct()
    named = part(kinds.join(words, "name", "left_semi").select("entity_id").distinct(), 0.8, "interpretation")
    sure = part(grounded.select("entity_id").distinct(), 1.0, "grounded")
    near = traverse.traverse(graph.edges, grounded.select(F.col("entity_id").alias("root")).distinct(), 1).select(F.col("node").alias("entity_id")).distinct()
    every = search.deduplicate(found.unionByName(named).unionByName(sure).unionByName(part(near, 0.7, "related")))
    signals = search.edge_signals(graph.edges)
    rows = every.join(kinds.drop("entity_type"), "entity_id").join(signals, "entity_id", "left").crossJoin(F.broadcast(known.select("target", "concepts")))
    rows = rows.withColumn("lexical", F.when((F.col("source") == "deterministic_search") & (F.col("entity_type") != "symbol"), F.col("score")).otherwise(0.0))
    rows = rows.withColumn("symbolic", F.when((F.col("source") == "deterministic_search") & (F.col("entity_type") == "symbol"), F.col("score")).otherwise(0.0))
    texts = F.filter(F.array("name", "path", "qualified_name"), lambda t: t.isNotNull())
    rows = rows.withColumn("task", search.task_relevance(texts, F.col("target"), F.col("concepts")))
    if changes is not None:
        rows = rows.join(search.change_relevance(changes).select("path", F.col("relevance").alias("git")), "path", "left")
    else:
        rows = rows.withColumn("git", F.lit(0.0))
    return search.rank(rows.select("entity_id", "entity_type", "name", "path", "score", "source", "lexical", "symbolic", "structural", "dependency", "task", "git"), ["lexical", "symbolic", "structural", "dependency", "task", "git"])


def package(graph: Graph, task: str, contents: DataFrame | None = None, changes: DataFrame | None = None, budget: int = CONTEXT_UNITS, depth: str | None = None) -> DataFrame:
    """The units of a task in order of priority: entity, relevance, content, signals, facts, inferences, priority, position.

    The budget is applied before facts and contents are read: its key doesn't depend on them.
    """
    ranked = checkpoint(candidates(graph, task, changes))
    hops = search.depth_decision(ranked.select("final_score").withColumnRenamed("final_score", "score"), depth).first()["depth"]
    spread = traverse.expand(traverse.ways_from(graph, "both", None), ranked.select("entity_id", F.col("final_score").alias("score")), hops)
    kinds = graph.vertices().select(F.col("id").alias("entity_id"), F.col("kind").alias("entity_type"), "path")
    order = F.struct("level", -F.col("score"), "entity_type", "entity_id")
    rows = spread.join(kinds, "entity_id").join(ranked.select("entity_id", "source", "git"), "entity_id", "left")
    rows = rows.withColumns({"ordinal": order, "relevance": F.col("score"), "source": F.coalesce("source", F.lit("relationship_expansion")), "reason": F.when(F.col("level") > 0, "Relationship-aware repository expansion")})
    top = checkpoint(search.within_budget(rows, budget))
    text = F.lit(None).cast("string")
    if contents is not None:
        top = top.join(contents.select("path", F.col("content").cast("string").alias("content")), "path", "left")
        text = F.when(F.col("entity_type") == "file", F.col("content"))
    merged = checkpoint(units.merge_items(units.signals(top).unionByName(units.facts(graph, top))))
    found = units.nested(top.select("entity_id", "entity_type", "path", "ordinal", "relevance", text.alias("content")), merged)
    return search.priorities(found.join(units.evidence_counts(merged), units.UNIT, "left").na.fill(0, ["evidence"])).drop("ordinal")
