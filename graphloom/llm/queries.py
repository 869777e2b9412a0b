"""The thin queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, language, line_dedup, lloyd, near_copies, neighbours, pii, quality, spelling, token_counts, toxicity
from ._spark import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits to every document: a word goes in the middle, one comes at the start, the end is cut."""
    n = F.char_length(F.coalesce("text", F.lit(""))).cast("int")
    one = lambda at, gone, new: F.struct(at.cast("int").alias("at"), F.lit(gone).alias("gone"), F.lit(new).alias("new"))
    edits = F.array(one(F.floor(n / 2), 7, ""), one(F.lit(0), 0, "Revised: "), one(n - 12, 20, "."))
    return token_counts.count_edited(table(spark, sf_dir, "documents").withColumn("edits", edits))


def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if re.match(r"op\d+_", k)}


def oracle_sql() -> dict[str, str]:
    return {"op12_lloyd": lloyd.sql()}
