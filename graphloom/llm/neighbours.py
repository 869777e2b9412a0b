"""Operator 4: approximate nearest neighbours by cross-polytope hashing.

Each table rotates unit vectors twice by three rounds of random signs and a fast Hadamard
transform; the nearest signed axis of the first rotation and that of the second (among its first
``SECOND`` axes) are a vector's cell. The largest inner product asks for length as well as direction, so
cells are parted by classes of length, half an octave each. A query ranks cells by the longest length in
them times its own coordinates on their axes, and probes, in each table, the best ones until they should
hold a share of all vectors that falls with their number (``share``). Cells are laid out in groups
whose number grows with the vectors, large groups in blocks; a query goes to the groups that hold a
cell that it probes, and only vectors of those cells are multiplied, exactly. Nothing but the best of a block leaves it.

Equal vectors form one class. As ties go to smaller ids, a class's ``k + 1`` smallest ids are
all that can appear in any result, so no class, however common, costs more than that.
Queries that meet fewer candidates than ``k`` while the table has more probe every cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import checkpoint

#: Tables; axes of the second rotation; classes of length.
TABLES, SECOND, LENGTHS = 8, 64, 6
#: Share of the vectors in the cells that a query probes in one table: SHARE for 10,000 vectors, falling with that power of their number.
SHARE, FALL = 0.032, 0.4
#: Vectors in a group, on average; groups of a table at least; vectors in a block and queries that meet it at once, on average, at most.
GROUP, GROUPS, BLOCK = 4096, 8, 8192


def width(dimension: int) -> int:
    return 1 << max(0, dimension - 1).bit_length()


def rotate(vectors: np.ndarray, table: int) -> np.ndarray:
    """Three rounds of signs and Hadamard transform of row vectors, padded to a power of two."""
    n, d = vectors.shape
    size = width(d)
    x = np.zeros((n, size))
    x[:, :d] = vectors
    signs = np.random.default_rng([table, size]).choice([-1.0, 1.0], (3, size))
    for round_signs in signs:
        x *= round_signs
        half = 1
        while half < size:
            y = x.reshape(n, -1, 2, half)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, size)
            half *= 2
        x /= np.sqrt(size)
    return x


def axes(dimension: int) -> tuple[int, int]:
    """The numbers of signed axes of both rotations."""
    return 2 * width(dimension), 2 * min(width(dimension), SECOND)


def _signed(vectors: np.ndarray, table: int, n: int) -> np.ndarray:
    """Coordinates on the first ``n`` signed axes: axis, its opposite, the next axis and so on."""
    x = rotate(vectors, table)[:, : n // 2]
    return np.stack([x, -x], axis=2).reshape(len(x), n)


def cells(vectors: np.ndarray, table: int) -> np.ndarray:
    """The cell of each row: the nearest signed axes of both rotations."""
    first, second = axes(vectors.shape[1])
    return _signed(vectors, 2 * table, first).argmax(1) * second + _signed(vectors, 2 * table + 1, second).argmax(1)


def share(n: int) -> float:
    return min(1.0, SHARE * (max(n, 1) / 10_000) ** -FALL)


def probes(vectors: np.ndarray, table: int, held: np.ndarray, part: float) -> list[np.ndarray]:
    """The cells that each row probes, class of length times cells plus cell, sorted.

    ``held``: vectors of each class of length. The best cells come first until their expected vectors
    are ``part`` of all.
    """
    first, second = axes(vectors.shape[1])
    n = first * second
    classes = np.flatnonzero(held)
    near = [_signed(vectors, 2 * table, first), _signed(vectors, 2 * table + 1, second)]
    out = []
    for x, y in zip(*near, strict=True):
        flat = (x[:, None] + y[None, :]).ravel()
        if len(classes) == 1:
            best = np.argpartition(-flat, min(n - 1, int(np.ceil(part * n)) - 1))[: max(1, int(np.ceil(part * n)))]
            out.append(np.sort(best + classes[0] * n))
            continue
        ranked = np.argsort(-(flat[None, :] * 2.0 ** (-classes[:, None] / 2)).ravel(), kind="stable")
        filled = np.cumsum((held[classes] / n)[ranked // n])
        best = ranked[: 1 + np.searchsorted(filled, part * held.sum() * (1 - 1e-12))]
        out.append(np.sort(best % n + classes[best // n] * n))
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _stack(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) and dimension of the vectors that take part."""
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole & some).withColumn("d", F.size("v"))


def _by_dimension(df: DataFrame, work, schema: str) -> DataFrame:
    """``work(batch, vectors)`` over the rows of each dimension in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column("d").to_numpy()
            for one in np.unique(d):
                part = batch.filter(pa.array(d == one)) if (d != one).any() else batch
                for at in range(0, part.num_rows, 4096):
                    piece = part.slice(at, 4096)
                    yield work(piece, _stack(piece.column("v")))

    return df.mapInArrow(run, schema)


def _index(classes: DataFrame) -> DataFrame:
    """A row for each class and table: d, t, g, cell, ids, v."""

    def work(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        n, size = len(x), int(np.prod(axes(x.shape[1])))
        own, groups, length = unit(x), batch.column("groups").to_numpy(), batch.column("length").to_numpy()
        cell = np.concatenate([cells(own, t) for t in range(TABLES)])
        every = np.tile(np.arange(n), TABLES)
        out = batch.take(pa.array(every))
        return pa.RecordBatch.from_arrays(
            [out.column("d"), pa.array(np.repeat(np.arange(TABLES), n), pa.int32()), pa.array(cell * groups[every] // size, pa.int32()), pa.array(cell + length[every] * size, pa.int32()), out.column("ids"), out.column("v")],
            names=["d", "t", "g", "cell", "ids", "v"],
        )

    return _by_dimension(classes, work, "d int, t int, g int, cell int, ids array<long>, v array<double>")


def _probing(queries: DataFrame, part: float | None) -> DataFrame:
    """A row for each query, table and group with a probed cell: d, t, g, cells, query_id, v."""

    def work(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        size, own = int(np.prod(axes(x.shape[1]))), unit(x)
        held, groups = np.array(batch.column("held")[0].as_py()), batch.column("groups")[0].as_py()
        rows, table, to, found = [], [], [], []
        for t in range(TABLES):
            for i, probed in enumerate(probes(own, t, held, part or share(int(held.sum())))):
                group = probed % size * groups // size
                order = np.argsort(group, kind="stable")
                for one in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                    rows.append(i)
                    table.append(t)
                    to.append(group[one[0]])
                    found.append(probed[one])
        out = batch.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([out.column("d"), pa.array(table, pa.int32()), pa.array(to, pa.int32()), pa.array(found, pa.list_(pa.int32())), out.column("vec_id"), out.column("v")], names=["d", "t", "g", "cells", "query_id", "v"])

    return _by_dimension(queries, work, "d int, t int, g int, cells array<int>, query_id long, v array<double>")


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All whole numbers from each ``low`` to below its ``high``."""
    n = high - low
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def _best(k: int):
    """Ranks a block: (query_id, vec_id, score), the k best for each query among the vectors of the cells that it probes."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left = left.take(np.argsort(left.column("cell").to_numpy(), kind="stable")).combine_chunks()
        base, cell = _stack(left.column("v").combine_chunks()), left.column("cell").to_numpy()
        ids = left.column("ids").to_pylist()
        asked, x = right.column("query_id").to_pylist(), _stack(right.column("v").combine_chunks())
        out: list[list] = [[], [], []]
        probed = right.column("cells").combine_chunks()
        for i, own in enumerate(asked):
            p = probed[i].values.to_numpy()
            met = _ranges(np.searchsorted(cell, p, "left"), np.searchsorted(cell, p, "right"))
            if not len(met):
                continue
            exact = (base[met] * x[i]).sum(1)
            if len(met) > k + 1:
                floor = -np.partition(-exact, k)[k]
                met, exact = met[exact >= floor], exact[exact >= floor]
            pairs = sorted((-s, v) for s, c in zip(exact.tolist(), met.tolist(), strict=True) for v in ids[c] if v != own)[:k]
            out[0] += [own] * len(pairs)
            out[1] += [v for _, v in pairs]
            out[2] += [-s for s, _ in pairs]
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _search(index: DataFrame, queries: DataFrame, k: int, part: float | None = None) -> DataFrame:
    asked = _probing(queries, part)
    groups = ["d", "t", "g"]
    # How many blocks a group's vectors and queries make: a row a group, that is one for some thousands of vectors.
    loads = index.groupBy(groups).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    askers = asked.groupBy(groups).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("askers"))
    plan = loads.join(askers, groups)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = index.join(plan, groups).withColumn("b", F.pmod(F.xxhash64("ids"), F.col("blocks")).cast("int")).withColumn("q", every("askers"))
    ask = asked.join(plan, groups).withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("askers")).cast("int")).withColumn("b", every("blocks"))
    keys = [*groups, "b", "q"]
    met = base.select(*keys, "cell", "ids", "v").groupBy(keys).cogroup(ask.select(*keys, "cells", "query_id", "v").groupBy(keys)).applyInArrow(_best(k), "query_id long, vec_id long, score double")
    found = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The ``k`` nearest of every query (rows whose vec_id is divisible by ``every``).

    Returns query_id, rank, vec_id, score. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do rows without vec_id; only vectors of one dimension
    meet. A vec_id that occurs repeatedly is found once and is never its own neighbour.
    """
    rows = _usable(vectors).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)))
    longest = rows.groupBy("d").agg(F.max("norm").alias("longest"))
    # One row a dimension.
    rows = rows.join(F.broadcast(longest), "d").withColumn("length", F.least(F.floor(2 * F.log2(F.col("longest") / F.col("norm")) + F.lit(1e-9)), F.lit(LENGTHS - 1)).cast("int"))
    kept = rows.dropDuplicates(["vec_id", "v"]).withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = kept.groupBy("v", "d").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("length").alias("length"))
    classes = checkpoint(classes)
    held = F.array(*[F.count_if(F.col("length") == i) for i in range(LENGTHS)]).alias("held")
    counts = classes.groupBy("d").agg(held, F.greatest(F.lit(GROUPS), F.ceil(F.count("*") / GROUP)).cast("int").alias("groups"))
    index = checkpoint(_index(classes.join(F.broadcast(counts), "d").select("d", "v", "ids", "length", "groups")))
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).join(F.broadcast(counts), "d").select("vec_id", "v", "d", "held", "groups")
    found = checkpoint(_search(index, queries, k))
    sizes = rows.groupBy("d").agg(F.count_distinct("vec_id").alias("size"))
    short = queries.join(found.groupBy(F.col("query_id").alias("vec_id")).count(), "vec_id", "left").join(F.broadcast(sizes), "d")
    short = checkpoint(short.where(F.coalesce("count", F.lit(0)) < F.least(F.lit(k), F.col("size") - 1)).select("vec_id", "v", "d", "held", "groups"))
    if short.isEmpty():
        return found
    more = _search(index, short, k, 1.0)
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(more)
