"""Operator 2: token counts that follow edits.

Each document keeps a segment tree over its pre-split words. A leaf covers about ``LEAF``
words: its text length and its tokens. Inner nodes hold the sums of both over their two
children, in arrays with the root at 1, so that the leaf at a character is found, and a leaf's
change is summed up, in steps of the tree's height. An edit replaces a span of characters.
Only the leaves that it touches, one leaf of context to the left and enough to the right until
the old and new splits meet again are split and encoded anew. Their words are dealt anew over
the same leaves, so leaves neither pile up nor run empty for good; where they would hold over
``MOST`` times ``LEAF`` words, the tree gets more leaves.

Trees are tables (``trees``); ``edit_trees`` takes a table of trees with edits and returns new trees.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import by_slice
from .bpe import Codec, codec, default_tokenizer

#: Pre-split words in a leaf; times that it may grow before the tree gets more leaves.
LEAF, MOST = 64, 4


@dataclass
class CountTree:
    """``lengths`` and ``counts`` hold the sums over nodes 1 to 2 * size - 1; leaves begin at ``size``."""

    text: str
    lengths: list[int]
    counts: list[int]
    encoded: int = 0

    @property
    def size(self) -> int:
        return len(self.counts) // 2

    @property
    def total(self) -> int:
        return self.counts[1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds character ``place`` (the last one with text beyond the end), and where it starts."""
        node, start = 1, 0
        place = min(place, self.lengths[1] - 1)
        while node < self.size:
            node *= 2
            if place >= start + self.lengths[node]:
                start += self.lengths[node]
                node += 1
        return node - self.size, start

    def start_of(self, leaf: int) -> int:
        """Where a leaf starts: the sums to its left."""
        node, start = leaf + self.size, 0
        while node > 1:
            if node % 2:
                start += self.lengths[node - 1]
            node //= 2
        return start

    def put(self, leaf: int, length: int, count: int) -> None:
        node = leaf + self.size
        more, tokens = length - self.lengths[node], count - self.counts[node]
        while node and (more or tokens):
            self.lengths[node] += more
            self.counts[node] += tokens
            node //= 2


def _summed(leaves: list[int]) -> list[int]:
    size = 1
    while size < len(leaves):
        size *= 2
    out = [0] * size + leaves + [0] * (size - len(leaves))
    for node in range(size - 1, 0, -1):
        out[node] = out[2 * node] + out[2 * node + 1]
    return out


def _dealt(words: list[str], leaves: int) -> list[list[str]]:
    """Words in order over ``leaves`` parts of equal size, but for one."""
    return [words[len(words) * i // leaves : len(words) * (i + 1) // leaves] for i in range(leaves)]


def build(own: Codec, text: str) -> CountTree:
    words = own.pieces(text)
    parts = [words[at : at + LEAF] for at in range(0, len(words), LEAF)] or [[]]
    return CountTree(text, _summed([sum(map(len, p)) for p in parts]), _summed([own.count(p) for p in parts]), len(words))


def edit(own: Codec, tree: CountTree, start: int, end: int, new: str) -> CountTree:
    """``tree`` after ``text[start:end]`` became ``new``; ``encoded`` counts the words encoded anew.

    The tree's arrays are changed in place. Positions past the ends are cut to the text.
    """
    start = max(0, min(start, len(tree.text)))
    end = max(start, min(end, len(tree.text)))
    text = tree.text[:start] + new + tree.text[end:]
    if not tree.lengths[1]:
        return build(own, text)
    size, margin, shift = tree.size, max([0, *map(len, own.special)]), len(new) - (end - start)
    first, began = tree.leaf_at(start)
    first = max(0, first - 1)
    began = tree.start_of(first)
    if any(s in text[max(0, began - margin) : began + margin] for s in own.special):
        return build(own, text)
    past = tree.leaf_at(end)[0]
    while True:
        past = min(past + 1, size)
        stop = tree.start_of(past) + shift if past < size else len(text)
        # A split is settled where it comes to the same words with more text after it.
        words = own.pieces(text[began:stop])
        if stop >= len(text):
            past = size
            break
        following = tree.lengths[size + past]
        longer = own.pieces(text[began : stop + margin + 1 + following])
        if following and longer[: len(words)] == words and sum(map(len, words)) == stop - began:
            break
    if len(words) > MOST * LEAF * (past - first):
        fresh = [words[at : at + LEAF] for at in range(0, len(words), LEAF)]
        around = lambda sums, measure: _summed([*sums[size : size + first], *map(measure, fresh), *sums[size + past :]])
        return CountTree(text, around(tree.lengths, lambda p: sum(map(len, p))), around(tree.counts, own.count), len(words))
    for leaf, part in zip(range(first, past), _dealt(words, past - first), strict=True):
        tree.put(leaf, sum(map(len, part)), own.count(part))
    return CountTree(text, tree.lengths, tree.counts, len(words))


TREE = "n_tokens long, lengths array<bigint>, counts array<bigint>, n_words long"


def _columns(made: list[CountTree]) -> list[pa.Array]:
    longs = pa.list_(pa.int64())
    return [pa.array([t.total for t in made], pa.int64()), pa.array([t.lengths for t in made], longs), pa.array([t.counts for t in made], longs)]


def trees(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, ``text`` and the tree of each document: n_tokens, lengths, counts and n_words, the words encoded for it.

    A null text is empty. Repeated rows repeat; an empty table gives none. Of other columns only
    ``edits`` is taken along.
    """
    path = tokenizer or default_tokenizer()
    also = ["edits"] if "edits" in docs.columns else []
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in also)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        made = [build(own, t or "") for t in batch.column("text").to_pylist()]
        names = ["doc_id", "text", *also]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *_columns(made), pa.array([t.encoded for t in made], pa.int64())], names=[*names, "n_tokens", "lengths", "counts", "n_words"])

    return by_slice(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also), work, f"doc_id long, text string{kinds}, {TREE}")


def edit_trees(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """New trees after edits: the columns of ``trees``, with n_tokens_before and n_words_again.

    ``rows``: a table of ``trees`` with ``edits``, an array of (at, gone, new) in the order in which
    they apply, positions in code points of the text as it then is. Null or empty edits leave a tree as it
    is. ``n_words`` is taken along from the tree, ``n_words_again`` counts the words encoded anew.
    """
    path = tokenizer or default_tokenizer()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        made, again = [], []
        for text, lengths, counts, edits in zip(batch.column("text").to_pylist(), batch.column("lengths").to_pylist(), batch.column("counts").to_pylist(), batch.column("edits").to_pylist(), strict=True):
            tree, n = CountTree(text or "", lengths, counts), 0
            for e in edits or []:
                tree = edit(own, tree, e["at"], e["at"] + e["gone"], e["new"] or "")
                n += tree.encoded
            made.append(tree)
            again.append(n)
        texts, long = pa.array([t.text for t in made], pa.string()), pa.int64()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, *_columns(made), batch.column("n_words"), batch.column("n_tokens"), pa.array(again, long)], names=["doc_id", "text", "n_tokens", "lengths", "counts", "n_words", "n_tokens_before", "n_words_again"])

    return by_slice(rows.select("doc_id", "text", "edits", "n_tokens", "lengths", "counts", "n_words"), work, f"doc_id long, text string, {TREE}, n_tokens_before long, n_words_again long")


def count_edited(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Counts before and after edits of ``rows`` (doc_id, text, edits), where no trees are kept yet.

    Trees are built and edited in one pass over the texts; they don't leave the task.
    """
    path = tokenizer or default_tokenizer()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        out: list[list[int]] = [[], [], [], []]
        for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True):
            tree, n = build(own, text or ""), 0
            before, words = tree.total, tree.encoded
            for e in edits or []:
                tree = edit(own, tree, e["at"], e["at"] + e["gone"], e["new"] or "")
                n += tree.encoded
            for to, value in zip(out, (before, tree.total, words, n), strict=True):
                to.append(value)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out)], names=["doc_id", "n_tokens", "n_tokens_edited", "n_words", "n_words_again"])

    return by_slice(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits"), work, "doc_id long, n_tokens long, n_tokens_edited long, n_words long, n_words_again long")
