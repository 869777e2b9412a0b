import hashlib
import math
import random

import duckdb
import numpy as np
from graphloom.llm import lloyd, queries

SF = "/root/testdata/sf0.01"


def brute(rows, k=8, rounds=10):
    """Plain Lloyd over Python's integers; rows of (vec_id, components or None)."""
    held = [(i, [math.floor(1024 * v) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(held, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    assign = lambda: [min((far(x, c), j) for j, c in enumerate(centroids)) for _, x in held]
    for _ in range(rounds):
        by = {}
        for (_, x), (_, j) in zip(held, assign(), strict=True):
            by.setdefault(j, []).append(x)
        centroids = [[sum(v) // len(by[j]) for v in zip(*by[j], strict=True)] if j in by else c for j, c in enumerate(centroids)]
    last = assign()
    fit = lambda v: v if v < 1 << 63 else None
    inertia = {j: sum(d for d, i in last if i == j) for j in range(len(centroids))}
    total = fit(sum(inertia.values()))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, fit(d), fit(inertia[j]), total, sha[j]) for (i, _), (d, j) in zip(held, last, strict=True)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_brute_force_and_sql(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows)
    assert len({r[1] for r in want}) > 1 and got(queries.op12_lloyd(spark, SF)) == want
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(duck.execute(queries.oracle_sql()["op12_lloyd"]).fetchall(), key=repr) == want


def drawn(rng, n, size=1.0):
    return [(i, [rng.choice((-1, 0, 1, 2)) * size / 1024 + rng.gauss(0, size / 300) for _ in range(64)]) for i in range(n)]


def test_ties_repeats_huge_numbers_and_bad_vectors(spark):
    rng = random.Random(3)
    same = [(i % 5, [float(i % 3)] * 64) for i in range(40)]
    huge = drawn(rng, 12) + [(90, [1e300] * 64), (91, [-1e30] * 64), (92, [5e5] * 64), (93, [4095.9] * 64), (94, [1e300] * 63 + [0.0])]
    bad = [(1, None), (2, []), (3, [0.5] * 63), (4, [0.5] * 63 + [None]), (5, [0.5] * 63 + [math.nan]), (6, [0.5] * 63 + [math.inf]), (None, [0.25] * 64), (None, [0.25] * 64)]
    for rows in (same, huge, bad + drawn(rng, 3), drawn(rng, 400), bad[:6], []):
        df = spark.createDataFrame([(i, x, "c", 1) for i, x in rows], "vec_id long, embedding array<double>, cluster string, slot int").repartition(3)
        assert got(lloyd.cluster(df)) == brute(rows)


def test_only_changed_centroids_and_moved_owners_are_compared():
    """The delta step gives what comparing with every centroid gives, ties included, over many rounds of moves."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        x = rng.integers(-4, 5, (50, 3)).astype(np.int32)
        centroids = rng.integers(-4, 5, (6, 3)).tolist()
        owner, own = np.full(50, lloyd.NOBODY, np.uint8), np.zeros(50)
        changed = list(range(6))
        for _ in range(6):
            owner, own = lloyd.reassigned(x, owner, own, centroids, changed)
            full = lloyd.distances(x, centroids)
            assert (owner == full.argmin(1)).all() and (own == full.min(1)).all()
            changed = sorted(rng.choice(6, rng.integers(1, 6), replace=False).tolist())
            for j in changed:
                centroids[j] = rng.integers(-4, 5, 3).tolist()


def test_limbs():
    for v in (0, 1, -1, (1 << 32) - 1, -(1 << 32), 12345678901234567890123456789, -(10**400)):
        assert sum(d << (32 * at) for at, d in lloyd.limbs(v)) == v and all(abs(d) < 1 << 32 for _, d in lloyd.limbs(v))
