"""Search, candidates and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CONTAINMENT_TYPES, CONTEXT_UNITS, Graph
from .order import positions

DEPENDENCY_TYPES = ("imports", "references", "inherits", "calls")
#: Precedence of candidate sources, weights of the priority formula.
SOURCE_PRIORITY = {"grounded": 4, "deterministic_search": 3, "related": 2, "interpretation": 1}
TYPE_WEIGHT = {"file": 1.0, "symbol": 0.85, "directory": 0.65}


def name_score(name: Column, path: Column, query: str) -> Column:
    """1 for the exact name or path, 0.8 for a part of the name, 0.5 of the path."""
    q = F.lit(query.lower())
    return F.when((F.lower(name) == q) | (F.lower(path) == q), 1.0).when(F.contains(F.lower(name), q), 0.8).when(F.contains(F.lower(path), q), 0.5)


def symbol_score(name: Column, qualified: Column, query: str) -> Column:
    q = F.lit(query.lower())
    return F.when(F.lower(name) == q, 1.0).when(F.lower(qualified) == q, 0.95).when(F.contains(F.lower(name), q), 0.8).when(F.contains(F.lower(qualified), q), 0.7)


def search(graph: Graph, query: str) -> DataFrame:
    """entity_id, entity_type, name, path, score, rank of all that match."""
    if not query.strip():
        raise ValueError("the query is empty")
    query = query.strip()
    files = graph.files.select(F.col("id").alias("entity_id"), F.lit("file").alias("entity_type"), "name", "path", name_score(F.col("name"), F.col("path"), query).alias("score"))
    dirs = graph.directories.select(F.col("id").alias("entity_id"), F.lit("directory").alias("entity_type"), "name", "path", name_score(F.col("name"), F.col("path"), query).alias("score"))
    owners = graph.files.select(F.col("id").alias("file_id"), "path")
    symbols = graph.symbols.withColumn("score", symbol_score(F.col("name"), F.col("qualified_name"), query)).where("score is not null").join(owners, "file_id", "left").select(F.col("id").alias("entity_id"), F.lit("symbol").alias("entity_type"), "name", "path", "score")
    return files.unionByName(dirs).where("score is not null").unionByName(symbols)


def ranked(found: DataFrame) -> DataFrame:
    """Position by (-score, type, lower name, path, id). A report: one ordered list of all matches."""
    return positions(found, F.desc("score"), "entity_type", F.lower("name"), "path", "entity_id")


def deduplicate(candidates: DataFrame) -> DataFrame:
    """One candidate for each entity: highest score, then the strongest source."""
    priority = F.coalesce(*[F.when(F.col("source") == s, p) for s, p in SOURCE_PRIORITY.items()], F.lit(0))
    best = candidates.withColumn("priority", priority).groupBy("entity_id", "entity_type").agg(F.max(F.struct("score", "priority", "source")).alias("b"))
    return best.select("entity_id", "entity_type", F.col("b.score").alias("score"), F.col("b.source").alias("source"))


def edge_signals(edges: DataFrame) -> DataFrame:
    """entity_id with its strongest containment (structural) and dependency edge."""
    ends = edges.select(F.col("source_id").alias("entity_id"), "relationship_type", "confidence").unionByName(edges.select(F.col("target_id").alias("entity_id"), "relationship_type", "confidence"))
    best = lambda types: F.coalesce(F.max(F.when(F.col("relationship_type").isin(*types), F.col("confidence"))), F.lit(0.0))
    return ends.groupBy("entity_id").agg(best(CONTAINMENT_TYPES).alias("structural"), best(DEPENDENCY_TYPES).alias("dependency"))


def task_relevance(texts: Column, target: Column, concepts: Column) -> Column:
    """1 where the target occurs in one of ``texts`` (array), else the share of concepts that do, at most 1."""
    within = lambda needle: F.exists(texts, lambda t: F.contains(F.lower(t), F.lower(needle)))
    share = F.when(F.size(concepts) > 0, F.least(F.lit(1.0), F.size(F.filter(concepts, within)) / F.size(concepts))).otherwise(0.0)
    return F.when(target.isNotNull() & within(target), 1.0).otherwise(share)


def relevance(graph: Graph, candidates: DataFrame, interpretations: DataFrame) -> DataFrame:
    """(task, entity_id, relevance) of files and symbols to tasks. ``candidates``: task, entity_id; ``interpretations``: task, target, concepts.

    A file is relevant by its name and path: 1 where the target stands there, else the share of concepts that do, or that a name of a symbol in the file
    holds. A symbol is relevant by its name and qualified name: 1 where one is the target, else concepts over both names by the number of concepts, at
    most 1. Upper and lower case count alike; blank targets and concepts don't count; a task without concepts has 0.
    """
    cleaned = F.filter(F.transform("concepts", lambda c: F.lower(F.trim(c))), lambda c: c != "")
    told = interpretations.select("task", F.nullif(F.lower(F.trim("target")), F.lit("")).alias("target"), F.coalesce(cleaned, F.array().cast("array<string>")).alias("concepts"))
    asked = candidates.select("task", "entity_id").distinct().join(told, "task")
    share = lambda n: F.when(F.size("concepts") > 0, F.least(F.lit(1.0), n / F.size("concepts"))).otherwise(0.0)

    files = asked.join(graph.files.select(F.col("id").alias("entity_id"), F.lower(F.concat_ws(" ", "name", "path")).alias("text")), "entity_id")
    files = files.withColumn("whole", F.coalesce(F.contains("text", "target"), F.lit(False)))
    # One row a concept; what the file's own text lacks is looked for in its symbols, without gathering their names.
    each = files.where(~F.col("whole")).select("task", "entity_id", "text", F.posexplode("concepts").alias("at", "concept"))
    own = each.where(F.contains("text", "concept")).select("task", "entity_id", "at")
    names = graph.symbols.select(F.col("file_id").alias("entity_id"), F.lower("name").alias("name")).distinct()
    held = each.where(~F.contains("text", "concept")).join(names, "entity_id").where(F.contains("name", "concept")).select("task", "entity_id", "at").distinct()
    met = own.unionByName(held).groupBy("task", "entity_id").agg(F.count("*").alias("n"))
    of_files = files.join(met, ["task", "entity_id"], "left").select("task", "entity_id", F.when(F.col("whole"), 1.0).otherwise(share(F.coalesce("n", F.lit(0)))).alias("relevance"))

    both = F.filter(F.array_distinct(F.array(F.lower("name"), F.lower(F.trim(F.coalesce("qualified_name", F.lit("")))))), lambda t: t != "")
    symbols = asked.join(graph.symbols.select(F.col("id").alias("entity_id"), both.alias("names")), "entity_id")
    hits = F.aggregate("concepts", F.lit(0), lambda n, c: n + F.size(F.filter("names", lambda t: F.contains(t, c))))
    of_symbols = symbols.select("task", "entity_id", F.when(F.array_contains("names", F.col("target")), 1.0).otherwise(share(hits)).alias("relevance"))
    return of_files.unionByName(of_symbols)


def change_relevance(changes: DataFrame) -> DataFrame:
    """path, commits, relevance = commits that touch it / 10, at most 1. ``changes``: commit_hash, path."""
    return changes.select("commit_hash", "path").distinct().groupBy("path").agg(F.count("*").alias("commits")).withColumn("relevance", F.least(F.lit(1.0), F.col("commits") / 10))


def rank(candidates: DataFrame, signals: list[str], most: int | None = None) -> DataFrame:
    """Final score = score and all signals, at most 1; position by (-final, type, id)."""
    total = F.col("score")
    for s in signals:
        total = total + F.coalesce(F.col(s), F.lit(0.0))
    rows = candidates.withColumn("final_score", F.least(F.lit(1.0), total))
    order = (F.desc("final_score"), "entity_type", "entity_id")
    if most is None:
        return positions(rows, *order)
    return rows.orderBy(*order).limit(most).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def depth_decision(candidates: DataFrame, mode: str | None = None) -> DataFrame:
    """One row: how deep to expand. minimal, recommended and deep are 0, 1 and 2."""
    fixed = {"minimal": 0, "recommended": 1, "deep": 2}
    if mode is not None:
        return candidates.sparkSession.range(1).select(F.lit(fixed[mode]).alias("depth"))
    counts = candidates.agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.8).alias("strong"))
    return counts.select(F.when(F.col("n") == 0, 0).when((F.col("n") >= 5) | (F.col("strong") >= 3), 2).otherwise(1).alias("depth"))


def within_budget(units: DataFrame, most: int = CONTEXT_UNITS) -> DataFrame:
    """The ``most`` units of highest relevance (earlier ordinal first), in their former order (position)."""
    top = units.orderBy(F.desc("relevance"), "ordinal").limit(most)
    return top.withColumn("position", F.row_number().over(Window.orderBy("ordinal")))


def priorities(units: DataFrame) -> DataFrame:
    """0.70 relevance + 0.20 type weight + 0.10 min(0.05 evidence, 0.15), within 0 and 1; position by (-priority, type, id)."""
    weight = F.coalesce(*[F.when(F.col("entity_type") == t, w) for t, w in TYPE_WEIGHT.items()], F.lit(0.0))
    value = 0.70 * F.col("relevance") + 0.20 * weight + 0.10 * F.least(F.lit(0.15), 0.05 * F.col("evidence"))
    rows = units.withColumn("priority", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6))
    return positions(rows, F.desc("priority"), "entity_type", "entity_id")
