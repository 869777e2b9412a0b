import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
from graphloom.llm import queries, spelling


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = 1 if i is None else crc32(f"{i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute_near(words):
    """Pairs that share a word with one letter gone, checked by a plain definition."""
    by = {}
    for w in words:
        for p in {("-", w[:i] + w[i + 1 :]) for i in range(len(w))} | {("=", w)} | {("*", i, w[:i] + w[i + 1 :]) for i in range(len(w))}:
            by.setdefault(p, []).append(w)
    found = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            found[w] |= {v for v in by[("*", i, w[:i] + w[i + 1 :])] if v != w and len(v) == len(w)}
            for v in by.get(("=", w[:i] + w[i + 1 :]), []):
                found[w].add(v)
                found[v].add(w)
    return found


def brute(rows):
    n = brute_words(rows)
    near, out = brute_near(n), {}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = brute(rows)
    assert sum(1 for v in want.values() if v[0]) > 300
    assert got(queries.op13_spelling(spark, "/root/testdata/sf0.01")) == want


@pytest.mark.parametrize("limit", [2, 64])
def test_dense_words_in_small_blocks(spark, monkeypatch, limit):
    """Words that share beginnings and ends by the hundred: every level of splitting, insertions in runs of one letter, chains of forms."""
    monkeypatch.setattr(spelling, "LIMIT", limit)
    rng = random.Random(limit)
    words = {"".join(rng.choice("aé") for _ in range(n)) for n in (5, 6, 7, 8) for _ in range(80)} | {"start" + "".join(rng.choice("abc") for _ in range(3)) + "end" for _ in range(60)}
    words |= {"long" * 2000, "long" * 1000 + "x" + "long" * 1000, "long" * 2000 + "s"}
    rows = [(i, " ".join([w] * rng.choice((1, 3, 6, 12, 24, 50)))) for i, w in enumerate(sorted(words))]
    want = brute(rows)
    assert any(v[0] and want[v[0]][0] for v in want.values())
    assert got(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_near_against_plain_distance():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice((5, 6)))) for _ in range(60)})
    letters = np.array([w.encode("latin-1") for w in words], dtype="S6").view(np.uint8).reshape(len(words), 6)
    size = (letters > 0).sum(1)
    pairs = [(i, j) for i, j in combinations(range(len(words)), 2)]
    i, j = (np.array(x) for x in zip(*pairs, strict=True))
    ok, first = spelling.near(letters, size, i, j, 5)
    want = brute_near(words)
    for (a, b), good, at in zip(pairs, ok, first, strict=True):
        u, v = sorted((words[a], words[b]), key=len)
        assert good == (v in want[u] and len(u) == 5)
        assert at == next((k for k in range(5) if len(u) == 5 and u[k] != v[k]), 5) or len(u) == 6


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "12 !?"), (None, "walked walked WALKED"), (4, "Walkéd walkÉd"), (4, "walkéd"), (5, "wälked " * 50_000), (6, "éÉéÉé éÉéÉé éÉéÉé")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert got(spelling.variants(df)) == brute(rows)
    assert spelling.variants(df.limit(0)).count() == 0 and spelling.variants(df.where("doc_id = 1")).count() == 0
    one = spelling.variants(spark.createDataFrame([("k1", "other other other")], "doc_id string, text string")).collect()
    assert [(r.word, r.form, r.root, r.n) for r in one] == [("other", None, "other", 3)]
