"""Operator 13: spelling variants, grouped by forward and reversed sorted dictionaries.

One edit leaves one half of a word intact. A block holds the words of ``s`` or ``s + 1`` letters that
share their first ``a`` and their last ``z`` letters; it owns the pairs whose first difference lies
between. The whole dictionary is the block (s, 0, 0), and each block splits at the middle of its free
letters into one that shares more of the beginning (a range of the forward dictionary) and one that
shares more of the end (a range of the reversed one). Blocks of over ``LIMIT`` words are split again,
down to one free letter, where the alphabet bounds them. So every pair is met in exactly one block,
and no block that is compared pairwise grows with the dictionary.

Blocks are ranges of a dictionary that Spark sorts; tasks scan their ranges, form the pairs within
each block and verify them, in numpy over whole batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpoint, release, slices, small_batches

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Words of fewer letters or occurrences are left out; one in MISSPELT runs of a document loses a letter.
LEAST_LETTERS, LEAST_COUNT, MISSPELT = 5, 3, 97
#: Words of a block that are compared pairwise; larger blocks are split.
LIMIT = 64
#: Different words that a task counts before it hands them on, pairs that are verified at once, blocks whose keys are broadcast at most (some 10 MB).
HELD, PAIRS, BROADCAST_BLOCKS = 200_000, 200_000, 100_000
BLOCK = ["s", "a", "z", "head", "tail"]


def misspelt(run: str, start: int) -> str:
    """The run, less one letter where 97 divides the crc32 of its id and itself; ``start``: crc32 of the id and a colon."""
    h = crc32(run.encode(), start)
    if h % MISSPELT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): every word of at least LEAST_LETTERS letters and LEAST_COUNT occurrences.

    Null texts have no words; runs of documents without doc_id lose no letter; repeated rows count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("doc").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if not text:
                        continue
                    start = None if doc is None else crc32(f"{doc}:".encode())
                    for own, n in Counter(RUN.findall(text.encode().translate(LOWER).decode())).items():
                        if len(own) >= LEAST_LETTERS:
                            word = own if start is None else misspelt(own, start)
                            if len(word) >= LEAST_LETTERS:
                                held[word] += n
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("string").alias("doc"), "text").mapInArrow(run, "word string, n long")
    return read.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _halves(rows: DataFrame) -> DataFrame:
    """The rows of blocks (word, n, s, a, z) in the two halves of their block, with the letters that each half shares.

    ``tail`` is read backwards: what it sorts is the reversed dictionary.
    """
    middle = F.col("a") + F.floor((F.col("s") - F.col("z") - F.col("a")) / 2).cast("int")
    half = lambda a, z: F.struct(a.alias("a"), z.alias("z"))
    split = rows.withColumn("half", F.explode(F.array(half(middle, F.col("z")), half(F.col("a"), F.col("s") - middle))))
    a, z = F.col("half.a"), F.col("half.z")
    return split.select("word", "n", "s", a.alias("a"), z.alias("z"), F.col("word").substr(F.lit(1), a).alias("head"), F.reverse("word").substr(F.lit(1), z).alias("tail"))


def _pairs(of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j with of[i] == of[j] of a sorted array, at most about PAIRS at a time."""
    last = np.searchsorted(of, of, side="right")
    first = np.arange(1, len(of) + 1)
    ends = np.cumsum(last - first)
    at = 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = (last - first)[at:to]
        left = np.repeat(np.arange(at, to), n)
        yield left, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)
        at = to


def near(letters: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pair is one edit apart, and its first difference; words of ``s`` and ``s + 1`` letters, padded with 0.

    Pairs of two longer words are never near here; they are compared where their length is ``s``.
    """
    short, long = np.where(size[left] <= size[right], left, right), np.where(size[left] <= size[right], right, left)
    same = size[long] == s
    differ = letters[short, :s] != letters[long, :s]
    any_, first = differ.any(1), differ.argmax(1)
    first = np.where(any_, first, s)
    ok = (differ.sum(1) == 1) & same
    longer = np.flatnonzero((size[short] == s) & ~same)
    if len(longer):
        # One letter more: after the first difference, the rest of the shorter word is the longer one's, a letter on.
        shifted = letters[short[longer], :s] != letters[long[longer], 1 : s + 1]
        ok[longer] = np.where(shifted.any(1), s - shifted[:, ::-1].argmax(1), 0) <= first[longer]
    return ok & (size[short] == s), first


def _scan(rows: DataFrame) -> DataFrame:
    """(word, near, n) in both directions for every pair that its block owns; a task reads whole blocks of a sorted range."""

    def verified(held: pa.Table) -> Iterator[pa.RecordBatch]:
        s_of = held.column("s").to_numpy()
        for s in np.unique(s_of):
            part = held.filter(pa.array(s_of == s))
            words, n = part.column("word").to_pylist(), part.column("n").to_numpy()
            letters = np.array([w.encode("latin-1") for w in words], dtype=f"S{s + 1}").view(np.uint8).reshape(len(words), s + 1)
            size, a, z = (letters > 0).sum(1), part.column("a").to_numpy(), part.column("z").to_numpy()
            step = max(1, PAIRS * 16 // (s + 1))
            for left, right in _pairs(part.column("block").to_numpy()):
                for at in range(0, len(left), step):
                    i, j = left[at : at + step], right[at : at + step]
                    ok, first = near(letters, size, i, j, int(s))
                    ok &= (first >= a[i]) & ((z[i] == 0) | (first < s - z[i]))
                    i, j = i[ok], j[ok]
                    if len(i):
                        one, two = np.concatenate([i, j]), np.concatenate([j, i])
                        made = [pa.array([words[k] for k in one]), pa.array([words[k] for k in two]), pa.array(n[two])]
                        yield pa.RecordBatch.from_arrays(made, names=["word", "near", "n"])

    def numbered(held: pa.Table) -> pa.Table:
        change = np.zeros(held.num_rows, bool)
        for name in BLOCK:
            column = held.column(name).combine_chunks()
            change[1:] |= pa.compute.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return held.append_column("block", pa.array(np.cumsum(change)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows:
                held = numbered(pa.concat_tables(([rest] if rest is not None else []) + [pa.Table.from_batches([batch])]))
                block = held.column("block").to_numpy()
                whole = int(np.searchsorted(block, block[-1]))
                yield from verified(held.slice(0, whole))
                rest = held.slice(whole).drop_columns(["block"])
        if rest is not None:
            yield from verified(numbered(rest))

    ordered = rows.select("word", "n", *BLOCK).repartitionByRange(*BLOCK).sortWithinPartitions(*BLOCK)
    return ordered.mapInArrow(run, "word string, near string, n long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, n): all pairs of ``words`` (word, n) that are one edit apart, in both directions, n of the near word."""
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("s")).where(F.col("s") >= LEAST_LETTERS)
    rows = _halves(rows.select("word", "n", "s", F.lit(0).alias("a"), F.lit(0).alias("z")))
    found = None
    while True:
        free = F.col("s") - F.col("z") - F.col("a")
        large = checkpoint(rows.groupBy(*BLOCK).agg(F.count("*").alias("m")).where((F.col("m") > LIMIT) & (free > 1)).drop("m"))
        n = large.count()
        if n and n <= BROADCAST_BLOCKS:
            large = F.broadcast(large)
        pairs = checkpoint(_scan(rows.join(large, BLOCK, "left_anti") if n else rows))
        found = pairs if found is None else found.unionByName(pairs)
        if not n:
            return found
        rows = checkpoint(_halves(rows.join(large, BLOCK, "left_semi")))
        release(rows.sparkSession)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last form that is reached, by doubling the steps of a pointer each round."""
    now = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        now = checkpoint(now.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """Per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n.

    Words are maximal runs of letters (A-Z lowered) of at least 5 letters and 3 occurrences; a word's
    form is its commonest near word, if that occurs at least twice as often (ties: the smaller one).
    Null and empty texts have no words, an empty table none; texts of any length are read whole, repeated
    rows count each, other columns are ignored.
    """
    words = checkpoint(count_words(docs))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    found = words.join(best, "word", "left")
    ok = -F.col("best.n") >= 2 * F.col("n")
    found = checkpoint(
        found.select("word", F.when(ok, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, -F.col("best.n")).alias("form_n"))
    )
    rooted = roots(found.where("form is not null"))
    return found.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
