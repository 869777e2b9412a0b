"""Context units and what is known of them, as rows: units, their items (signals, facts, inferences) and the items' evidence.

An item row is one piece of evidence of one item of one unit. Merging and enriching are joins and aggregates over
these rows, so that nothing gathers a unit's contents or a hub's relations in one row; ``nested`` puts together the units
that are left in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Graph

#: ``ordinal``: place of the unit; ``place``: of the item in it; ``at``: of the evidence in the item. Facts have ``value``, signals and inferences ``number``.
UNIT = ["entity_id", "entity_type"]
ITEM = [*UNIT, "ordinal", "kind", "place", "name", "value", "number", "at", "source_id", "description"]
KEY = [*UNIT, "kind", "name", "value", "number"]


def _items(rows: DataFrame, *found: tuple[Column, Column]) -> DataFrame:
    """Item rows of ``rows`` from (condition, item struct) pairs, in their order."""
    every = F.array(*(F.when(when, item) for when, item in found))
    return rows.select(*UNIT, "ordinal", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("x")).select(*UNIT, "ordinal", "x.*").select(*ITEM)


def _item(kind: str, place: int, name: str | Column, value: Column | None, number: Column | None, source: Column, description: Column) -> Column:
    null = lambda t: F.lit(None).cast(t)
    return F.struct(
        F.lit(kind).alias("kind"), F.format_string("%03d", F.lit(place)).alias("place"), (F.lit(name) if isinstance(name, str) else name).alias("name"),
        (null("string") if value is None else value.cast("string")).alias("value"), (null("double") if number is None else number.cast("double")).alias("number"),
        F.lit(0).alias("at"), source.alias("source_id"), description.alias("description"),
    )


def signals(candidates: DataFrame) -> DataFrame:
    """Item rows of what speaks for each candidate: how it was selected, its history, and the relation through which it was reached.

    candidates: entity_id, entity_type, ordinal, score, source, reason (or null), git, and the evidence columns of
    ``traverse.expand`` (null for candidates that weren't reached).
    """
    text = F.format_string("elected from %s with relevance score %.3f", "source", "score")
    own = F.when(F.coalesce("reason", F.lit("")) != "", F.concat("reason", F.lit("; s"), text)).otherwise(F.concat(F.lit("S"), text))
    reached = F.format_string("Retrieved through %s relationship at depth %d; relationship-aware repository expansion", "relationship_type", "depth")
    return _items(
        candidates,
        (F.lit(True), _item("signal", 0, "selection", None, F.col("score"), F.col("entity_id"), own)),
        (F.coalesce("git", F.lit(0.0)) > 0, _item("signal", 1, "git_relevance", None, F.col("git"), F.col("entity_id"), F.lit("Git history indicates repeated changes to this file"))),
        (F.col("from_id").isNotNull(), _item("signal", 2, "relationship_retrieval", None, F.col("candidate_confidence"), F.col("from_id"), reached)),
    )


def facts(graph: Graph, units: DataFrame) -> DataFrame:
    """Item rows of what the graph says of each unit (entity_id, entity_type, ordinal): file and symbol columns that aren't null, then every edge at it, by id."""
    units, own = units.select(*UNIT, "ordinal"), F.col("entity_id")
    told = lambda c: F.initcap(F.col(c).cast("string"))
    of = lambda i, name, value, why: (value.isNotNull(), _item("fact", i, name, value, None, own, why))
    files = units.where("entity_type = 'file'").join(graph.files.withColumnRenamed("id", "entity_id"), "entity_id")
    why = F.concat(F.lit("file metadata: "), "path")
    columns = [("file_path", F.col("path")), ("file_type", F.col("file_type")), ("extension", F.col("extension")), ("size", F.col("size")), ("generated", told("is_generated")), ("ignored", told("is_ignored"))]
    of_files = _items(files, *(of(i, n, v, why) for i, (n, v) in enumerate(columns)))
    symbols = units.where("entity_type = 'symbol'").join(graph.symbols.withColumnRenamed("id", "entity_id"), "entity_id")
    said = F.concat(F.lit("symbol metadata: "), "name")
    columns = [("symbol_name", "name"), ("symbol_kind", "kind"), ("start_line", "start_line"), ("end_line", "end_line"), ("qualified_name", "qualified_name"), ("signature", "signature"), ("parent_symbol", "parent_symbol_id")]
    of_symbols = _items(symbols, *(of(i, n, F.col(c), said) for i, (n, c) in enumerate(columns)))
    edges = graph.edges.select("id", "relationship_type", "source_id", "target_id")
    ends = edges.select(F.col("source_id").alias("entity_id"), *edges.columns).unionByName(edges.where("source_id <> target_id").select(F.col("target_id").alias("entity_id"), *edges.columns))
    kind = F.col("relationship_type")
    item = F.struct(
        F.lit("fact").alias("kind"), F.concat(F.lit("100|"), "id").alias("place"), F.lit("relationship").alias("name"), F.concat_ws(":", kind, "source_id", "target_id").alias("value"),
        F.lit(None).cast("double").alias("number"), F.lit(0).alias("at"), F.col("id").alias("source_id"), F.concat(F.lit("relationship: "), kind).alias("description"),
    )
    of_edges = units.join(ends, "entity_id").select(*UNIT, "ordinal", item.alias("x")).select(*UNIT, "ordinal", "x.*").select(*ITEM)
    return of_files.unionByName(of_symbols).unionByName(of_edges)


def merge(units: DataFrame) -> DataFrame:
    """Units (entity_id, entity_type, ordinal, relevance, content) by entity: first ordinal, highest relevance, first content that isn't null."""
    content = F.min_by("content", F.when(F.col("content").isNotNull(), F.col("ordinal")))
    return units.groupBy(*UNIT).agg(F.min("ordinal").alias("ordinal"), F.max("relevance").alias("relevance"), content.alias("content"))


def merge_items(items: DataFrame) -> DataFrame:
    """Item rows by entity, kind, name and value, each with its first place; of equal evidence under an item the first stays.

    ``ordinal`` and ``place`` become those of the item's first row and ``at`` the order of its evidence: by unit, place in it, and former ``at``.
    """
    place = F.struct("ordinal", "place", "at")
    evidence = items.groupBy(*KEY, "source_id", "description").agg(F.min(place).alias("p"))
    first = items.groupBy(*KEY).agg(F.min(F.struct("ordinal", "place")).alias("first"))
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}")) for k in KEY]
    on = same[0]
    for part in same[1:]:
        on = on & part
    rows = evidence.alias("e").join(first.alias("f"), on)
    return rows.select(*(F.col(f"e.{k}").alias(k) for k in KEY), F.col("f.first.ordinal").alias("ordinal"), F.col("f.first.place").alias("place"), F.col("e.p").alias("at"), "e.source_id", "e.description")


def nested(units: DataFrame, merged: DataFrame) -> DataFrame:
    """``units`` (merged) with signals, facts and inferences as ordered arrays of structs with their evidence; for the few units of a package."""
    here = merged.join(units.select(*UNIT), UNIT, "left_semi")
    piece = F.struct("at", "source_id", "description")
    each = here.groupBy(*KEY, "ordinal", "place").agg(F.sort_array(F.collect_list(piece)).alias("e"))
    shown = F.transform("e", lambda x: F.struct(x["source_id"].alias("source_id"), x["description"].alias("description")))
    item = F.struct("ordinal", "place", "name", "value", "number", shown.alias("evidence"))
    rows = each.groupBy(*UNIT).agg(*(F.sort_array(F.collect_list(F.when(F.col("kind") == k, item))).alias(k) for k in ("signal", "fact", "inference")))
    as_signal = lambda x: F.struct(x["name"].alias("name"), x["number"].alias("value"), x["evidence"].alias("evidence"))
    as_fact = lambda x: F.struct(x["name"].alias("fact_type"), x["value"].alias("value"), x["evidence"].alias("evidence"))
    as_inference = lambda x: F.struct(x["name"].alias("claim"), x["number"].alias("confidence"), x["evidence"].alias("evidence"))
    shaped = rows.select(*UNIT, F.transform("signal", as_signal).alias("signals"), F.transform("fact", as_fact).alias("facts"), F.transform("inference", as_inference).alias("inferences"))
    joined = units.join(shaped, UNIT, "left")
    none = lambda c: F.coalesce(c, F.array().cast(shaped.schema[c].dataType))
    return joined.withColumns({c: none(c) for c in ("signals", "facts", "inferences")})


def evidence_counts(merged: DataFrame) -> DataFrame:
    """(entity_id, entity_type, evidence): pieces of evidence under each unit's signals."""
    return merged.where("kind = 'signal'").groupBy(*UNIT).agg(F.count("*").alias("evidence"))
