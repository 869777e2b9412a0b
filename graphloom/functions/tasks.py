"""Task sentences: tokens, action, target, concepts and references, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word pattern, path pattern, identifier pattern, action words, capitalised words that are no target.
WORD = r"[A-Za-z0-9_./\\-]+"
PATH = r"(?<![\w./-])(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+(?![\w./-])"
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$"
ACTIONS = "add analyze build check clean create debug delete describe explain find fix generate get implement inspect list locate modify refactor remove retrieve search show test trace update validate verify".split()
PLAIN = "class function method module file error test tests".split()
# Why a task may not be enough to go by.
REASONS = ("task is empty", "task intent is missing", "task concepts are missing", "requested action is missing")


def tokens(task: Column) -> Column:
    return F.regexp_extract_all(task, F.lit(WORD), F.lit(0))


def _is_action(t: Column) -> Column:
    return F.lower(t).isin(*ACTIONS)


def _is_target(t: Column) -> Column:
    named = t.rlike("^[A-Z][A-Za-z0-9_]*$") & ~F.lower(t).isin(*PLAIN)
    return t.rlike(r"[/._]|^.+?[A-Z]") | named


def understand(tasks: DataFrame) -> DataFrame:
    """``tasks`` (task) with requested_action, target, concepts, state and the reasons for doubt.

    The first action word is the action and never the target. Blank and null tasks are insufficient; tasks with a text in their column ``ambiguity``, if there
    is one, are ambiguous, with that text as a reason; all others are clear, also those that lack an action or concepts, which is a reason only.
    """
    words = tokens(F.trim("task"))
    action = F.get(F.filter("tokens", _is_action), F.lit(0))
    at = F.array_position(F.transform("tokens", lambda t: F.lower(t)), F.col("requested_action"))
    targets = F.filter("tokens", lambda t, i: _is_target(t) & (F.coalesce(at, F.lit(0)) != i + 1))
    rows = tasks.withColumn("tokens", words).withColumn("requested_action", F.lower(action)).withColumn("target", F.get(targets, F.lit(0))).withColumn("concepts", F.array_distinct("tokens"))
    blank = F.coalesce(F.trim("task") == "", F.lit(True))
    unclear = F.nullif(F.trim("ambiguity"), F.lit("")) if "ambiguity" in tasks.columns else F.lit(None).cast("string")
    lacks = (blank, blank, F.coalesce(F.size("concepts"), F.lit(0)) <= 0, F.col("requested_action").isNull())
    reasons = F.array(*[F.when(when, text) for when, text in zip(lacks, REASONS, strict=True)], unclear)
    state = F.when(blank, "insufficient").when(unclear.isNotNull(), "ambiguous").otherwise("clear")
    return rows.withColumn("state", state).withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull())).drop("tokens")


def references(tasks: DataFrame) -> DataFrame:
    """(task, reference, kind): paths in the sentence, then the target and the concepts as file or identifier."""
    known = understand(tasks)
    named = F.array_distinct(F.concat(F.regexp_extract_all("task", F.lit(PATH), F.lit(0)), F.filter(F.array("target"), lambda t: t.isNotNull()), F.filter("concepts", lambda c: c.rlike(IDENTIFIER) | F.contains(c, F.lit("/")))))
    rows = known.select("task", F.explode(named).alias("reference"))
    return rows.withColumn("kind", F.when(F.contains("reference", F.lit("/")) | F.col("reference").rlike(r"\.(py|pyi|js|jsx|ts|tsx|java|go|rs|c|h|cc|cpp|hpp|rb|swift|kt|php|md|toml|json|yaml|yml)$"), "file").otherwise("identifier"))


def ground(references: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task, reference, status, matches, entity_id, confidence): exact path 1.0, qualified name 1.0, else name 0.9; one match grounds."""
    by_path = references.where("kind = 'file'").join(files.select(F.col("path").alias("reference"), F.col("id").alias("entity_id")), "reference").withColumn("confidence", F.lit(1.0))
    ids = references.where("kind = 'identifier'")
    full = ids.join(symbols.select(F.col("qualified_name").alias("reference"), F.col("id").alias("entity_id")), "reference").withColumn("confidence", F.lit(1.0))
    bare = ids.join(symbols.select(F.col("name").alias("reference"), F.col("id").alias("entity_id")), "reference").withColumn("confidence", F.lit(0.9))
    hits = by_path.unionByName(full).unionByName(bare).groupBy("task", "reference", "confidence").agg(F.count_distinct("entity_id").alias("matches"), F.min("entity_id").alias("entity_id"))
    best = hits.groupBy("task", "reference").agg(F.max_by(F.struct("confidence", "matches", "entity_id"), "confidence").alias("b"))
    out = references.join(best, ["task", "reference"], "left")
    n = F.coalesce("b.matches", F.lit(0))
    return out.select("task", "reference", "kind", F.when(n == 0, "unresolved").when(n == 1, "grounded").otherwise("ambiguous").alias("status"), n.alias("matches"), F.when(n == 1, F.col("b.entity_id")).alias("entity_id"), F.when(n == 1, F.col("b.confidence")).alias("confidence"))
