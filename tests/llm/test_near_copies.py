import random
import re

import numpy as np
import pyarrow as pa
from graphloom.llm import _graph, _words, near_copies, queries


def brute(rows, k, percent):
    """doc_id -> (set size, smallest doc_id reachable), over all pairs that share a shingle."""
    held, by_shingle = {}, {}
    for i, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        held[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
        for s in held[i]:
            by_shingle.setdefault(s, []).append(i)
    root = {i: i for i in held}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in held.items():
        both = {}
        for s in own:
            for j in by_shingle[s]:
                if j < i:
                    both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if 100 * n >= percent * (len(own) + len(held[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in held.items()}


def test_driver_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_near_copies(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(rows, 3, 85)


def perturbed(seed, n):
    """A large group of copies of one text with few to many changed words: chains and contested buckets."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(120)] = rng.choice(vocabulary)
        out.append((i * 7 + 3, " ".join(words)))
    return out


def test_contested_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rows = perturbed(1, 220) + [(5000 + i, f"only {i} words" + " and more of the same" * (i % 3)) for i in range(40)]
    for k, percent in ((3, 85), (5, 80)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_copies.near_copies(df, k, percent).collect()}
        assert got == {i: (n, c, c == i) for i, (n, c) in brute(rows, k, percent).items()}


def test_several_texts_under_one_id(spark):
    """Each text of a doc_id is linked as a document of its own; an id's component is the smallest id that any of its texts reaches."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, want = [], {}
    for i in range(30):
        one, other = ([word() for _ in range(60)] for _ in range(2))
        rows += [(i, " ".join(one)), (i, " ".join(other)), (1000 + i, " ".join([*one[:-1], "x"])), (2000 + i, " ".join([*other[:-1], "y"]))]
        want |= {i: i, 1000 + i: i, 2000 + i: i}
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id < 1000) for r in got)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "ONE"), (4, "one two"), (3, "one two"), (None, "one two"), (2, "x " * 60_000), (1, "x " * 50_000), (8, "one")]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n int, component_id string")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_copies.near_copies(df, 3, 85).collect()]
    key = lambda t: (t[0] is None, t)
    want = [(5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (8, 1, 8, True), (9, 1, 8, False), (4, 1, 3, False), (3, 1, 3, True), (None, 1, None, False), (2, 1, 1, False), (1, 1, 1, True)]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = near_copies.drop_near_copies(df, 3, 85)
    assert kept.columns == df.columns and sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, i) for i in (1, 3, 5, 6, 7, 8, 8)] + [(True, None)]
    assert near_copies.near_copies(df.limit(0), 3, 85).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    got = {r.node: r.root for r in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    for n in (4, 30, 400, 3000):
        for share in (0.3, 0.8, 0.95):
            got = []
            for _ in range(40):
                both = round(n * share)
                x = rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
                a, b = near_copies.sketch(x[:n], 352), near_copies.sketch(x[n - both :], 352)
                got.append(near_copies.estimate((a == b).mean(), n, n, 352))
            assert abs(np.mean(got) - both / (2 * n - both)) < 0.08
    values = np.array([1, 2, 3, 1 << 40, (1 << 63) + 5, (1 << 64) - 1], np.uint64)
    assert list(near_copies.compress(values) >> 10) == [63, 62, 62, 23, 0, 0]


def test_shingle_hashes():
    words = _words.words(pa.array(["a b c a b c d"]))
    assert len(set(_words.shingles(words.hash, 3))) == 4 and len(_words.shingles(words.hash[:2], 3)) == 1


def test_earlier_roots_take_no_round(spark, monkeypatch):
    """Stars are found as they are; new links are added to earlier roots, not to all links from the start."""
    held, checkpoint = [], _graph.checkpoint
    monkeypatch.setattr(_graph, "checkpoint", lambda df: held.append(1) or checkpoint(df))
    stars = spark.createDataFrame([(9, 1), (8, 1), (1, 7), (5, 3), (5, 5)], "a long, b long")
    roots = _graph.components(stars)
    assert {r.node: r.root for r in roots.collect()} == {1: 1, 7: 1, 8: 1, 9: 1, 3: 3, 5: 3} and len(held) == 1
    more = spark.createDataFrame([(8, 5), (20, 9), (31, 30)], "a long, b long")
    got = {r.node: r.root for r in _graph.components(_graph.with_roots(more, roots)).collect()}
    assert got == {**dict.fromkeys((1, 3, 5, 7, 8, 9, 20), 1), 30: 30, 31: 30}
