"""Documents made ready for training, in five stages.

Each stage takes (spark, docs, sf_dir) and all that the one before kept; all but the last return
the columns of ``documents``. Rows without doc_id and null texts pass every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, line_dedup, near_copies, quality
from graphloom.llm._spark import checkpoint, table

#: Documents of a lower probability of good quality go.
LEAST_QUALITY = 0.3


def _new_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects; it learns from the labelled rows of ``documents``."""
    net = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = _new_name(docs, "quality")
    scored = quality.score(docs, net, name)
    return scored.where(F.col("text").isNull() | (F.col(name) >= LEAST_QUALITY)).select(docs.columns)


def once_only_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; ``n_chars`` follows.

    A document whose lines all stand elsewhere is gone as a whole; texts that were blank before stay.
    """
    name = _new_name(docs, "blank")
    blank = F.trim(F.regexp_replace("text", r"\s+", " ")) == ""
    out = line_dedup.dedup_lines(docs.withColumn(name, blank))
    out = out.where(F.col("text").isNull() | F.col(name) | ~blank).select(docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies (five words, similarity 0.8)."""
    return near_copies.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes: ids, n_tokens and whether the text comes back whole."""
    return bpe.tokenised(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", once_only_lines),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", token_ids),
]

#: The network, SimHash and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = checkpoint(docs)
    return docs
