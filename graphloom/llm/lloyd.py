"""Operator 12: k-means by delta Lloyd, in whole numbers.

Blocks of vectors persist with their assignments: each vector's owner and its distance to it. The
sums and counts of the clusters persist too, ``k`` rows of them. In a round only centroids that changed are
compared with every vector; a vector meets the others only where its owner moved away from it, for an
unchanged centroid that lost before can win only then. Vectors that change their owner are taken from
the one cluster's sums and added to the other's: tasks hand on nothing but these signed integers.

Distances are products of doubles where all numbers are below 2**22, so that every sum is exact, and
Python's integers beyond. Sums travel in limbs of 32 bits, so no size of a component or table overflows.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpoint, release, small_batches

#: Components are multiples of 1 / SCALE; vectors in a block; numbers below NARROW take the fast way; an owner that no vector has.
SCALE, ROWS, NARROW, NOBODY = 1024, 128, 1 << 22, 255
BLOCKS = "ids array<long>, comps binary, owner binary, own binary, wide string"
FIELDS = ["ids", "comps", "owner", "own", "wide"]
LIMB = 32
LONGEST = (1 << 63) - 1


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(limb, digit) of a signed integer, least first; digits have its sign."""
    sign, rest, at = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        if rest & 0xFFFFFFFF:
            yield at, sign * (rest & 0xFFFFFFFF)
        rest >>= LIMB
        at += 1


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of rows to centroids: exact doubles where all numbers are small, else Python's integers."""
    if x.dtype != object and all(abs(c) < NARROW for row in centroids for c in row):
        a, b = x.astype(np.float64), np.array(centroids, np.float64).reshape(len(centroids), x.shape[1])
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    rows = [[int(v) for v in r] for r in x]
    out = np.empty((len(rows), len(centroids)), object)
    for i, r in enumerate(rows):
        for j, c in enumerate(centroids):
            out[i, j] = sum((p - q) ** 2 for p, q in zip(r, c, strict=True))
    return out


def reassigned(x: np.ndarray, owner: np.ndarray, own: np.ndarray, centroids: list[list[int]], changed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances to them, given those before ``changed`` centroids moved; NOBODY compares with all."""
    new, n = owner == NOBODY, len(x)
    met = distances(x, [centroids[j] for j in changed])
    if own.dtype == object and met.dtype != object:
        met = np.array([[int(v) for v in r] for r in met], object).reshape(met.shape)
    if met.dtype == object and own.dtype != object:
        own = np.array([int(v) for v in own], object)
    far = np.inf if met.dtype != object else 1 << 5000
    table = np.full((n, len(centroids)), far, met.dtype if met.dtype == object else np.float64)
    table[np.arange(n)[~new], owner[~new]] = own[~new]
    table[:, changed] = met
    moved = np.isin(owner, changed)
    after = table[np.arange(n), np.where(new, 0, owner)]
    away = np.flatnonzero(new | (moved & (after > own)))
    rest = [j for j in range(len(centroids)) if j not in changed]
    if len(away) and rest:
        table[np.ix_(away, rest)] = distances(x[away], [centroids[j] for j in rest])
    best = table.argmin(1)
    return best.astype(np.uint8), table[np.arange(n), best]


def _read(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, components, owners, distances) of each block of a batch."""
    for ids, comps, owner, own, wide in zip(*(batch.column(c).to_pylist() for c in FIELDS), strict=True):
        if wide is not None:
            held = json.loads(wide)
            x = np.empty((len(ids), len(held["x"][0])), object)
            x[:] = held["x"]
            yield ids, x, np.frombuffer(owner, np.uint8), np.array(held["own"] + [None], object)[:-1]
        else:
            yield ids, np.frombuffer(comps, np.int32).reshape(len(ids), -1), np.frombuffer(owner, np.uint8), np.frombuffer(own, np.int64).astype(np.float64)


def _written(ids: list, x: np.ndarray, owner: np.ndarray, own: np.ndarray) -> dict:
    if x.dtype == object or own.dtype == object:
        return {"ids": ids, "owner": owner.tobytes(), "wide": json.dumps({"x": [[int(v) for v in r] for r in x], "own": [int(v) for v in own]})}
    return {"ids": ids, "comps": x.astype(np.int32).tobytes(), "owner": owner.tobytes(), "own": own.astype(np.int64).tobytes()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"ids": pa.list_(pa.int64()), "comps": pa.binary(), "owner": pa.binary(), "own": pa.binary(), "wide": pa.string(), "slot": pa.int32(), "limb": pa.int32(), "value": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles, of Python's integers where one is past NARROW."""
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * values)
    if (np.abs(scaled) < NARROW).all():
        return scaled.astype(np.int32)
    out = np.empty(values.shape, object)
    for i, row in enumerate(values):
        out[i] = [math.floor(v * SCALE) if abs(v) < 1 << 53 else int(v) * SCALE for v in row.tolist()]
    return out


def _blocks(kept: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            ids = batch.column("vec_id").to_pylist()
            wide = (np.abs(values) >= NARROW // SCALE).any(1)
            rows = []
            for part in (np.flatnonzero(~wide), np.flatnonzero(wide)):
                for at in range(0, len(part), ROWS):
                    some = part[at : at + ROWS]
                    rows.append(_written([ids[i] for i in some], whole(values[some]), np.full(len(some), NOBODY, np.uint8), np.zeros(len(some))))
            if rows:
                yield _batch(rows).select(FIELDS)

    return kept.mapInArrow(run, BLOCKS)


def _round(state: DataFrame, centroids: list[list[int]], changed: list[int], inertia: bool) -> DataFrame:
    """The blocks after one assignment, and beside them what the sums gain or lose: (slot, limb, value), once a task.

    Slot j * (d + 1) + i is component i of cluster j, with its count at i = d; slots past these are the clusters' inertia.
    """
    k, d = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gained: dict[int, int] = {}

        def add(slot: int, value: int) -> None:
            gained[slot] = gained.get(slot, 0) + int(value)

        for batch in batches:
            rows = []
            for ids, x, owner, own in _read(batch):
                best, now = reassigned(x, owner, own, centroids, changed)
                moved = best != owner
                for j in np.union1d(best[moved], owner[moved]).tolist():
                    into, out = x[moved & (best == j)], x[moved & (owner == j)]
                    if j != NOBODY:
                        kind = object if x.dtype == object else np.int64
                        for i, v in enumerate(into.sum(0, dtype=kind) - out.sum(0, dtype=kind)):
                            add(j * (d + 1) + i, v)
                        add(j * (d + 1) + d, len(into) - len(out))
                if inertia:
                    for j in np.unique(best).tolist():
                        add(k * (d + 1) + j, sum(int(v) for v in now[best == j]))
                rows.append(_written(ids, x, best, now))
            if rows:
                yield _batch(rows)
        told = [{"slot": slot, "limb": at, "value": v} for slot, value in gained.items() for at, v in limbs(value)]
        if told:
            yield _batch(told)

    return state.mapInArrow(run, f"{BLOCKS}, slot int, limb int, value long")


def _told(after: DataFrame) -> dict[int, int]:
    """slot -> sum over all tasks; k * (d + 2) slots of a few limbs come back, whatever the table holds."""
    found = after.where("slot is not null").groupBy("slot", "limb").agg(F.sum("value").alias("value")).collect()
    out: dict[int, int] = {}
    for slot, at, value in found:
        out[slot] = out.get(slot, 0) + (int(value) << (LIMB * at))
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, mark: str = "3:") -> DataFrame:
    """Per kept vector of ``vectors`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of another size than ``size``, null ones, and those with a null or non-finite component
    are left out. Components become floor(1024 * x). Centroids start as the vectors with the
    smallest sha256 of ``mark`` and vec_id (ties: the smaller vector; null ids last), as many as there are up to ``k``;
    an assignment goes to the nearest centroid (ties: the smaller number). After ``rounds`` rounds, or
    sooner where no centroid changes any more, vectors are assigned once more. Repeated rows count each; an empty table gives no rows; other
    columns are ignored. Distances and inertias past a long are null.
    """
    if not 0 < k < NOBODY:
        raise ValueError("k must be from 1 to 254")
    x = F.col("embedding").cast("array<double>")
    good = (F.size("x") == size) & ~F.exists("x", lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & good)
    first = kept.orderBy(F.sha2(F.concat(F.lit(mark), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "x").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return kept.sparkSession.createDataFrame([], schema)
    small_batches(kept.sparkSession)
    centroids = [[int(v) for v in r] for r in (whole(np.array([row.x]))[0] for row in first)]
    d, state, changed = size, checkpoint(_blocks(kept)), list(range(len(centroids)))
    sums, counts = [[0] * d for _ in centroids], [0] * len(centroids)
    for turn in range(rounds + 1):
        last = turn == rounds or not changed
        after = checkpoint(_round(state, centroids, changed, last))
        state = after.where("slot is null").select(FIELDS)
        told = _told(after)
        if last:
            break
        for slot, value in told.items():
            j, i = divmod(slot, d + 1)
            if i == d:
                counts[j] += value
            else:
                sums[j][i] += value
        moved = [[v // n for v in s] if n else c for s, n, c in zip(sums, counts, centroids, strict=True)]
        changed = [j for j, (a, b) in enumerate(zip(centroids, moved, strict=True)) if a != b]
        centroids = moved
        del after
        release(kept.sparkSession)
    inertias = [told.get(len(centroids) * (d + 1) + j, 0) for j in range(len(centroids))]
    fits = lambda v: v if v <= LONGEST else None
    about = [(fits(v), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for v, c in zip(inertias, centroids, strict=True)]
    total = fits(sum(inertias))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, owner, own in _read(batch):
                made = [ids, owner.tolist(), [fits(int(v)) for v in own], [about[j][0] for j in owner], [total] * len(ids), [about[j][1] for j in owner]]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    return state.mapInArrow(rows, schema)


def sql(k: int = 8, rounds: int = 10, size: int = 64, mark: str = "3:") -> str:
    """The same clusters as plain Lloyd rounds in DuckDB's SQL, every vector against every centroid in each."""
    rule = "sha256('{mark}' || vec_id)".format(mark=mark)
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)""",
        f"long AS MATERIALIZED (SELECT rid, unnest(range({size})) AS d, unnest(x) AS x FROM kept)",
        f"starts AS MATERIALIZED (SELECT rid, (row_number() OVER (ORDER BY {rule} NULLS LAST, x))::INTEGER - 1 AS j FROM kept QUALIFY j < {k})",
        "c0 AS MATERIALIZED (SELECT j, d, x AS c FROM starts JOIN long USING (rid))",
    ]
    near = "a{t} AS MATERIALIZED (SELECT rid, j, dist FROM (SELECT rid, j, sum((x - c) * (x - c)) AS dist FROM long JOIN c{t} USING (d) GROUP BY rid, j) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, j) = 1)"
    for t in range(rounds):
        steps.append(near.format(t=t))
        steps.append(f"s{t} AS (SELECT j, d, sum(x) AS s, count(*) AS n FROM a{t} JOIN long USING (rid) GROUP BY j, d)")
        steps.append(f"c{t + 1} AS MATERIALIZED (SELECT j, d, CASE WHEN n IS NULL THEN c ELSE ((s - (((s % n) + n) % n)) // n)::BIGINT END AS c FROM c{t} LEFT JOIN s{t} USING (j, d))")
    steps.append(near.format(t=rounds))
    steps.append(f"marks AS (SELECT j, sha256(string_agg(c::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY j)")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, j::INTEGER AS cluster, dist::BIGINT AS distance, (sum(dist) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(dist) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM a{rounds} JOIN kept USING (rid) JOIN marks USING (j)"""
