"""Each stage against a plain version on its own input."""

import re

import numpy as np
import pytest
from graphloom.llm import bpe, quality

from .test_line_dedup import norm
from .test_near_copies import brute as near_brute

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        before = docs
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((before.toPandas().set_index("doc_id"), docs.toPandas().set_index("doc_id"), before.columns, docs.columns))
    return out


def test_columns(stages):
    assert all(before == after for _, _, before, after in stages[:-1])
    assert len(pipeline.STAGES) == 5


def test_quality(spark, stages):
    before, after, *_ = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    seen = labels.index.intersection(before.index)
    good, bad = seen[labels[seen] == 1], seen[labels[seen] == 0]
    assert good.isin(after.index).mean() > 0.95 and bad.isin(after.index).mean() < 0.15
    net = quality.fit([(before.text[i], int(labels[i])) for i in seen][:150])
    data = np.frombuffer("".join(before.text[:5]).encode(), np.uint8)
    ends = np.cumsum([0, *(len(t.encode()) for t in before.text[:5])])
    one_by_one = [quality.document_scores(net, data[a:b], np.array([0, b - a]))[0] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert np.allclose(quality.document_scores(net, data, ends), one_by_one, atol=1e-5)


def test_lines(stages):
    """Repeated lines go; documents that lose all of them go too, so that no text is newly blank."""
    before, after, *_ = stages[1]
    assert set(after.index) <= set(before.index)
    assert all(t.strip() or not before.text[i].strip() for i, t in after.text.items())
    every = {norm(x) for t in after.text for x in t.split("\n") if norm(x)}
    gone = before.text[~before.index.isin(after.index)]
    assert len(gone) and np.mean([norm(x) in every for t in gone for x in t.split("\n") if norm(x)]) > 0.5
    seen, repeated = set(), 0
    for i in sorted(before.index):
        kept = (after.text[i] if i in after.index else "").split("\n")
        fresh = [x for x in before.text[i].split("\n") if not norm(x) or not (norm(x) in seen or seen.add(norm(x)))]
        repeated += len(before.text[i].split("\n")) - len(fresh)
        if kept != fresh and i in after.index:  # fuzzy repeats are fewer still
            it = iter(fresh)
            assert all(x in it for x in kept)
        assert i not in after.index or after.n_chars[i] == len(after.text[i])
    assert repeated > 0
    lines = [norm(x) for t in after.text for x in t.split("\n") if norm(x)]
    assert len(lines) == len(set(lines))


def test_near_copies(stages):
    before, after, *_ = stages[2]
    want = {i for i, (_, root) in near_brute(list(before.text.items()), 5, 80).items() if root == i}
    assert set(after.index) == want


def test_decontamination(spark, stages):
    before, after, *_ = stages[3]
    split = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, t in before.text.items() if any(x in split(t) for x in items)}
    gone = set(before.index) - set(after.index)
    assert leaked <= gone and len(gone - leaked) <= 3


def test_tokens(stages):
    before, after, *_ = stages[4]
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    assert set(before.index) == set(after.index) and after.exact.all()
    for i in list(before.index)[:150]:
        assert list(after.ids[i]) == other.encode(before.text[i], add_special_tokens=False).ids and after.n_tokens[i] == len(after.ids[i])


def test_run_is_the_stages(spark, stages):
    got = {r.doc_id: r.n_tokens for r in pipeline.run(spark, SF).collect()}
    assert got == stages[4][1].n_tokens.to_dict()


def test_edges_of_each_stage(spark, tmp_path):
    """Nulls in any column, empty and blank texts, repeated rows, an empty table and extra columns with clashing names."""
    prose = "\n".join(f"Line {i} of a text with words enough to be read as prose, and number {i * i} in it." for i in range(12))
    rows = [(1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (2, None, None, None, None), (None, prose, "en", "a", 2), (3, "", "en", "a", 3), (4, " \n ", None, "b", 4), (5, "word " * 3000, "en", "b", 5)]
    schema = "doc_id long, text string, lang string, source string, __quality int"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.drop("__quality").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "A question that no text here holds, with twelve words or more in all?"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, str(tmp_path))
            if name != pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            found = [r.doc_id for r in out.collect()]
            assert set(found) <= {1, 2, 3, 4, 5, None} and (found.count(2) == 1 or given is not docs), name
