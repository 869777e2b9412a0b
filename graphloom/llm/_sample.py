"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a sample at most, by expectation; twice as many is the hard bound.
ROWS = 4000
#: Longer texts are not drawn for fitting (they are scored whole).
LONGEST = 60_000


def fold(modulus: int) -> Column:
    """crc32 of doc_id written as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def draw(rows: DataFrame, n: int = ROWS) -> DataFrame:
    """About ``n`` rows, chosen by a hash of doc_id so that every run draws the same ones."""
    total = rows.count()
    rate = min(1.0, n / max(1, total))
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30)) < int(rate * (1 << 30))).limit(2 * n)


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, n: int = ROWS) -> list[tuple[str, int]]:
    """(text, label) of a bounded sample of the rows that ``train`` admits.

    Only ids and labels are drawn first; at most ``2 n`` of them are broadcast to the one
    pass over the texts. Rows with a null or blank label, id or text are left out; of repeated
    ids with different labels every row counts.
    """
    wanted = draw(labels.where(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label), n)
    texts = docs.where(train & F.col("text").isNotNull() & (F.char_length("text") <= LONGEST)).select("doc_id", "text")
    found = texts.join(F.broadcast(wanted), "doc_id").select("doc_id", "text", label).limit(4 * n).collect()
    return [(r[1], int(r[2])) for r in sorted(found, key=lambda r: (r[0], r[1]))]
