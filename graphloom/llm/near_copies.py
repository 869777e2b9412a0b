"""Operator 3: near copies by HyperMinHash.

A document's set of word shingles is sketched in one pass: each shingle falls into one of
the buckets, and a bucket keeps the leading-zero count and ``MANTISSA`` further bits of its
least hash (empty buckets borrow from a fixed sequence of others). Bands of registers are
the candidate keys. Their number follows from the threshold so that a pair on it is missed with
a chance of at most ``MISS``. Candidates are compared by their registers, corrected
for registers that agree by chance, and those that may reach the threshold are
confirmed on the full sets.

Equal sets form one class, so copies are never compared. In each bucket of a band all classes
are first compared with the one that shares most buckets, and linked ones are joined to
components; buckets that still hold several components, and over two classes, are compared with
``PIVOTS`` more of their classes. What is then left is compared pairwise, in blocks of at
most ``BLOCK`` classes a side, each pair in the first band that it shares; a block gives a
spanning set of links. So the number of links never grows with the square of a group.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._graph import components, with_roots
from ._spark import by_slice, checkpoint, release

#: Chance to miss a pair on the threshold; registers at most; bits kept below the leading one.
MISS, REGISTERS, MANTISSA = 1e-6, 420, 10
#: Standard errors by which a sketch may fall short of the threshold before its pair is confirmed.
SLACK = 6.0
#: Further pivots before what is left of a bucket is compared in blocks; classes on each side of a block; classes that are broadcast at most (some 20 MB).
PIVOTS, BLOCK, BROADCAST_IDS = 2, 256, 400_000
U = np.uint64


@functools.lru_cache(maxsize=8)
def bands(threshold: float) -> tuple[int, int]:
    """(number of bands, registers in a band): the longest bands that fit."""
    for rows in range(12, 0, -1):
        share = threshold**rows
        count = math.ceil(math.log(MISS) / math.log1p(-share)) if share < 1 else 1
        if rows * count <= REGISTERS:
            return count, rows
    raise ValueError("the threshold is too low for this many registers")


@functools.lru_cache(maxsize=8)
def _lenders(size: int) -> np.ndarray:
    """For each register the order in which it asks others."""
    rng = np.random.default_rng(size)
    return np.argsort(rng.random((size, size)), axis=1)


def compress(values: np.ndarray) -> np.ndarray:
    """Leading-zero count and MANTISSA bits after the leading one."""
    v = values.astype(np.uint64) | U(1)
    top = np.zeros(len(v), np.int64)
    x = v.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = x >= (U(1) << U(step))
        top[big] += step
        x[big] >>= U(step)
    low = np.where(top >= MANTISSA, v >> np.maximum(top - MANTISSA, 0).astype(np.uint64), v << np.maximum(MANTISSA - top, 0).astype(np.uint64))
    return ((63 - top).astype(np.uint16) << np.uint16(MANTISSA)) | (low & U((1 << MANTISSA) - 1)).astype(np.uint16)


def sketch(shingles: np.ndarray, size: int) -> np.ndarray:
    """The registers of a set that isn't empty."""
    where = (shingles % U(size)).astype(np.int64)
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        np.minimum.at(least, where, _words.mix(shingles ^ U(0x5851F42D4C957F2D)))
    held = np.zeros(size, bool)
    held[where] = True
    if not held.all():
        order, empty = _lenders(size), np.flatnonzero(~held)
        for at in range(24):
            ask = order[empty, at]
            ok = held[ask]
            least[empty[ok]] = least[ask[ok]]
            empty = empty[~ok]
            if not len(empty):
                break
        if len(empty):
            least[empty] = least[order[empty, held[order[empty]].argmax(1)]]
    return compress(least)


def band_keys(registers: np.ndarray, count: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(1, count + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
        for column in registers.reshape(count, rows).T:
            key = _words.mix(key ^ column.astype(np.uint64))
    return key.view(np.int64)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray, size: int) -> np.ndarray:
    """Jaccard from the share of equal registers, less what agrees by chance.

    Two registers of different least hashes agree where both have one leading-zero count and one
    mantissa: at most two hashes in three have the same count, and 2**-MANTISSA of these agree.
    Registers that borrow repeat what others hold and add nothing to correct.
    """
    chance = 2 / 3 * 2.0**-MANTISSA
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def least_estimate(threshold: float, n: np.ndarray, size: int) -> np.ndarray:
    """The sketch value below which a pair can't be on the threshold; small sets repeat their registers."""
    free = np.minimum(size, np.maximum(n, 1))
    return threshold - SLACK * np.sqrt(threshold * (1 - threshold) / free)


def sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; the whole sequence where words are fewer."""
    found = _words.words(column)
    bounds = found.bounds()
    return [np.unique(_words.shingles(found.hash[a:b], shingle)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _sketched(docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """doc_id, n, two set keys and the registers (null for an empty set)."""
    count, rows = bands(threshold)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, first, second, held = [], [], [], []
        for own in sets(batch.column("text"), shingle):
            n.append(len(own))
            for to, key in zip((first, second), _keys(own), strict=True):
                to.append(key)
            held.append(sketch(own, count * rows).tobytes() if len(own) else None)
        long = pa.int64()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, long), pa.array(first, long), pa.array(second, long), pa.array(held, pa.binary())], names=["doc_id", "n", "k1", "k2", "registers"])

    return by_slice(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n long, k1 long, k2 long, registers binary")


def _banded(classes: DataFrame, threshold: float) -> DataFrame:
    """(bucket, id): the band keys of each class."""
    count, rows = bands(threshold)

    def run(batches):
        for batch in batches:
            keys = [band_keys(np.frombuffer(r, np.uint16), count, rows) for r in batch.column("registers").to_pylist()]
            if keys:
                ids = np.repeat(batch.column("id").to_numpy(), count)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids)], names=["bucket", "id"])

    return classes.select("id", "registers").mapInArrow(run, "bucket long, id long")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sketches may reach the threshold."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
            x, y = (np.stack([np.frombuffer(r, np.uint16) for r in batch.column(c).to_pylist()] or [np.zeros(1, np.uint16)]) for c in ("ra", "rb"))
            size = x.shape[1]
            if len(n):
                likely = estimate((x == y).mean(1), n, m, size) >= least_estimate(threshold, np.minimum(n, m), size)
                likely &= np.minimum(n, m) >= threshold * np.maximum(n, m)
                yield batch.select(["a", "b"]).filter(pa.array(likely))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _keys(own: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    with np.errstate(over="ignore"):
        return int(_words.mix(own).sum().astype(np.int64)), int(_words.mix(own ^ U(0xC2B2AE3D27D4EB4F)).sum().astype(np.int64))


def _full_sets(docs: DataFrame, ids: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """(id, words): the full sets of the classes in ``ids`` (id), from the texts of the documents that stand for them."""
    wanted = checkpoint(classes.select("id", "doc", "k1", "k2", "n").join(ids, "id", "left_semi"))
    from_docs = wanted.select("doc").distinct()
    if wanted.count() <= BROADCAST_IDS:
        from_docs, wanted = F.broadcast(from_docs), F.broadcast(wanted)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(from_docs, "doc", "left_semi")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = sets(batch.column("text"), shingle)
        keys = [_keys(s) for s in held]
        long = pa.int64()
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], long), pa.array([k for _, k in keys], long), pa.array([len(s) for s in held], long), pa.array([s.astype(np.int64) for s in held], pa.list_(long))],
            names=["k1", "k2", "n", "words"],
        )

    # Several texts under one doc_id are told apart by the keys of their sets.
    read = by_slice(rows, work, "k1 long, k2 long, n long, words array<long>")
    return read.join(wanted.drop("doc"), ["k1", "k2", "n"]).select("id", "words").dropDuplicates(["id"])


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    full = checkpoint(_full_sets(docs, checkpoint(ids), classes, shingle))

    def run(batches):
        for batch in batches:
            x, y = batch.column("wa"), batch.column("wb")
            ok = []
            for i in range(batch.num_rows):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda x: full.select(F.col("id").alias(x), F.col("words").alias(f"w{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _within_blocks(rows: DataFrame, percent: int, count: int, size_rows: int) -> DataFrame:
    """Spanning links between components within the blocks of contested buckets."""
    threshold = percent / 100

    def run(key, block):
        block = block.combine_chunks()
        ids, roots, n, side = (block.column(c).to_numpy() for c in ("id", "root", "n", "chunk"))
        registers = np.stack([np.frombuffer(r, np.uint16) for r in block.column("registers").to_pylist()])
        held = block.column("words").chunk(0) if block.num_rows else None
        bucket, i, j = key[0].as_py(), key[1].as_py(), key[2].as_py()
        keys = np.stack([band_keys(r, count, size_rows) for r in registers])
        band = int(np.argmax(keys[0] == bucket))
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        out: list[list[int]] = [[], []]
        for a in left:
            others = right[right > a] if i == j else right
            others = others[(roots[others] != roots[a]) & (np.minimum(n[others], n[a]) >= threshold * np.maximum(n[others], n[a]))]
            if not len(others):
                continue
            equal = registers[others] == registers[a]
            ok = estimate(equal.mean(1), n[a], n[others], registers.shape[1]) >= least_estimate(threshold, np.minimum(n[a], n[others]), registers.shape[1])
            ok &= ~equal[:, : band * size_rows].reshape(len(others), band, size_rows).all(2).any(1) if band else True
            for b in others[ok]:
                x, y = find(int(roots[a])), find(int(roots[b]))
                if x == y:
                    continue
                p, q = held[int(a)].values.to_numpy(), held[int(b)].values.to_numpy()
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    parent[max(x, y)] = min(x, y)
                    out[0].append(int(ids[a]))
                    out[1].append(int(ids[b]))
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable) and kept.

    Links join sets with 100 * intersection >= percent * union. Texts without words (null,
    empty, blank) have empty sets and are linked with nothing. Rows without doc_id keep a null
    component and aren't kept. Rows that repeat a doc_id with one text repeat the result; where
    one doc_id has several texts each is linked as a document of its own.
    """
    threshold = percent / 100
    count, rows = bands(threshold)
    every = checkpoint(_sketched(docs, shingle, threshold))
    classes = every.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("doc"), F.min_by("registers", "doc_id").alias("registers"))
    # A number of its own for each class, fixed by the checkpoint: documents of several texts stand in several classes.
    classes = checkpoint(classes.withColumn("id", F.monotonically_increasing_id()))
    banded = _banded(classes, threshold)
    shared = banded.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    members = checkpoint(banded.join(shared, "bucket"))
    release(docs.sparkSession)
    degree = members.groupBy("id").agg(F.count("*").alias("degree"))
    contested = members.join(degree, "id").withColumn("root", F.col("id"))
    roots = None
    for turn in range(PIVOTS + 1):
        order = -F.col("degree") if turn == 0 else F.xxhash64("id", F.lit(turn)).bitwiseAND(F.lit((1 << 62) - 1))
        pivots = contested.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "id", "root")).alias("p")).select("bucket", F.col("p.id").alias("b"), F.col("p.root").alias("rb"))
        pairs = contested.select("bucket", F.col("id").alias("a"), "root").join(pivots, "bucket").where("root <> rb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        likely = checkpoint(_likely(pairs, classes, threshold))
        more = checkpoint(_confirmed(likely, docs, classes, shingle, percent))
        release(docs.sparkSession)
        if roots is None or not more.isEmpty():
            roots = components(with_roots(more, roots))
        rooted = contested.drop("root").where("m > 2").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        open_buckets = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
        contested = checkpoint(rooted.join(open_buckets, "bucket"))
        release(docs.sparkSession)
        if contested.isEmpty():
            break
    if not contested.isEmpty():
        full = _full_sets(docs, checkpoint(contested.select("id").distinct()), classes, shingle)
        chunks = F.ceil(F.col("m") / BLOCK).cast("int")
        dealt = contested.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        dealt = dealt.select("bucket", "id", "root", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
        whole = dealt.join(full, "id").join(classes.select("id", "n", "registers"), "id")
        more = checkpoint(_within_blocks(whole, percent, count, rows))
        release(docs.sparkSession)
        if not more.isEmpty():
            roots = components(with_roots(more, roots))
    linked = classes.select("k1", "k2", "n", "id", "doc").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = linked.groupBy("root").agg(F.min("doc").alias("least"))
    found = every.join(linked.join(least, "root").select("k1", "k2", "n", "least"), ["k1", "k2", "n"], "left")
    return _result(found)


def _result(found: DataFrame) -> DataFrame:
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` less all but the smallest doc_id of each component; rows without doc_id stay."""
    gone = near_copies(docs, shingle, percent).where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
