"""Held-out accuracy on the driver's tables, and small edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from graphloom.llm import _words, language, quality, queries, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def accuracy(spark, report, label):
    truth = spark.read.parquet(f"{SF}/labels.parquet")
    r = report.where("held_out").join(truth, "doc_id").select((F.col("predicted") == F.col(label)).cast("int").alias("ok"), label).toPandas()
    return r.groupby(label).ok.mean(), len(r)


@pytest.mark.parametrize("query, label", [(queries.op7_quality, "quality"), (queries.op8_toxicity, "toxic")])
def test_held_out(spark, query, label):
    by_class, n = accuracy(spark, query(spark, SF), label)
    assert n > 700 and by_class.min() > 0.85 and by_class.mean() > 0.92, by_class


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op10_language(spark, SF)
    rows = got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"), "score").toPandas()
    assert len(rows) > 2000 and rows.ok.mean() > 0.98
    assert rows.score.between(0, 1).all() and abs(rows.score.mean() - rows.ok.mean()) < 0.05


def test_folds_are_crc32_of_the_written_id(spark):
    got = {r.doc_id: r.held_out for r in queries.op7_quality(spark, "/root/testdata/sf0.001").collect()}
    assert all(held == (zlib.crc32(str(i).encode()) % 5 == 0) for i, held in got.items())


EDGE = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "12 !?", None, "s"), (4, "word " * 40_000, "en", "s"), (4, "word " * 40_000, "en", "s"), (None, "a", "en", "s"), (6, "日本語 é", "en", "s")]


def test_edges(spark):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for rows in (labels, none):
        for part in (quality.report(docs, rows), toxicity.report(docs, rows)):
            got = part.collect()
            assert len(got) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.report(docs).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en"
    empty = docs.limit(0)
    assert quality.report(empty, none).count() == toxicity.report(empty, labels).count() == language.report(empty).count() == 0


def brute_segments(scores):
    """Ruzzo and Tompa's definition: take the best segment, then the same left and right of it."""
    def best(a, b):
        top = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if top is None or top[0] <= 0:
            return []
        _, _, i, j = top
        return [*best(a, i), (i, j), *best(j, b)]

    return best(0, len(scores))


def test_segments_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        scores = [round(rng.uniform(-1, 1), 6) for _ in range(rng.randrange(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(scores))] == brute_segments(scores)


def plain_toxic(rows):
    """Word and beginning counts by document, log-odds and z, with plain dictionaries."""
    import math
    import re
    from collections import Counter

    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    forms = lambda w: {w} | {w[:n] + "*" for n in toxicity.STEMS if len(w) > n}
    seen = {y: Counter(f for t, z in rows if z == y for f in {f for w in split(t) for f in forms(w)}) for y in (0, 1)}
    total, most = {y: sum(seen[y].values()) for y in seen}, 0.5 * (len(seen[0]) + len(seen[1]))
    telling = {}
    for f in seen[0].keys() | seen[1].keys():
        a, b = seen[1][f] + 0.5, seen[0][f] + 0.5
        odds = math.log(a / (total[1] + most - a)) - math.log(b / (total[0] + most - b))
        if abs(odds) / math.sqrt(1 / a + 1 / b) > 3.2 and abs(odds) > 1.5 and seen[int(odds > 0)][f] >= 5:
            telling[f] = odds

    def scores(text):
        out = []
        for w in split(text):
            own = [telling.get(f, 0.0) for f in forms(w)]
            out.append(max(own) if max(own) > 0 else min(-0.02, *own))
        return out

    return split, scores


def test_toxic_passages_against_plain_odds(spark):
    """Toxic and clean words both count; passages are the original text, and the tables' order of rows doesn't matter."""
    rng = random.Random(4)
    common, foul, kind = ([f"{a}{i}word" for i in range(40)] for a in ("c", "foul", "kind"))
    rows = []
    for i in range(400):
        text = rng.choices(common, k=30) + (rng.choices(foul[:3], k=6) if i % 4 == 0 else rng.choices(kind[:3], k=6))
        rows.append((" ".join(text).title(), int(i % 4 == 0)))
    split, scores = plain_toxic(rows)
    model = toxicity.fit(rows)
    assert (model.scores > 0).any() and (model.scores < 0).any()
    for text, _ in rows[:40]:
        found = _words.words(pa.array([text]), _words.NOT_ALNUM)
        assert np.allclose(model.word_scores(toxicity.tokens(found)), scores(text))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows[:40])], "doc_id int, text string")
    for r in toxicity.score(docs, model).collect():
        text, y = rows[r.doc_id]
        assert [(x.start, x.end) for x in r.spans] == [(a, b) for a, b, _ in toxicity.segments(np.array(scores(text)))]
        assert all(x.text in text and split(x.text) == split(text)[x.start : x.end] for x in r.spans)
        assert (r.score >= 0.3) == bool(y) and r.n_significant == sum(x.significant for x in r.spans)


def test_words_match_a_plain_split():
    texts = ["", " a  B\tc\n", None, "é ê", "x" * 500, "the the The", "\x0bq\x1cr"]
    found = _words.words(pa.array(texts))
    got = [[] for _ in texts]
    for i, row in enumerate(found.row):
        got[row].append(found.text(i))
    import re

    lower = {c: c + 32 for c in range(65, 91)}
    assert got == [re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower)) for t in texts]
    by_word = {}
    for i, h in enumerate(found.hash):
        assert by_word.setdefault(found.text(i), h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert _words.hash_word("the") in found.hash
    assert list(found.bounds()) == [0, 0, 3, 3, 5, 6, 9, 10]
