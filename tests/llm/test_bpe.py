import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, queries, token_counts

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = bpe.default_tokenizer()
    return bpe.Codec(path), tokenizers.Tokenizer.from_file(path)


def texts(n=400):
    rng = random.Random(5)
    marks = [chr(c) for c in (0, 9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x180E, 0x2003, 0x200B, 0x2028, 0x3000, 0xFEFF)]
    parts = ["the", " The", "aaaa", "'ll", "'S", "don't", "12", "½", "Ünï", "日本語", "🙂", "<|endoftext|>", "  ", "\n\n", "!!", "é", "क्षि", "_", "-" * 70, "ththedtion", *marks]
    out = ["", " ", "a" * 3000, " " * 500, "<|endoftext|>", "x<|endoftext|> y"]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_same_ids_and_text_as_the_library(both):
    own, other = both
    for text in texts():
        ids = other.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids).decode() == other.decode(ids, skip_special_tokens=False)


def test_cut_characters_decode_as_the_library_does(both):
    own, other = both
    rng = random.Random(1)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(12)]
        assert own.decode(ids).decode() == other.decode(ids, skip_special_tokens=False)


def test_small_automaton_takes_leftmost_lowest_rank():
    base = {bytes([c]): c - 97 for c in b"abc"}
    auto = bpe.MergeAutomaton(base, [(0, 0, 3), (3, 1, 4), (1, 2, 5)])
    assert auto.encode(b"aaa") == [3, 0]
    assert auto.encode(b"aaab") == [3, 0, 1]
    assert auto.encode(b"aabc") == [4, 2]


def test_edits_count_as_a_whole_new_count(both):
    own, _ = both
    rng = random.Random(3)
    for text in texts(60):
        text = text * rng.randrange(1, 30)
        tree = token_counts.build(own, text)
        assert tree.total == len(own.encode(text))
        for _ in range(6):
            at = rng.randrange(len(tree.text) + 1)
            tree = token_counts.edit(own, tree, at, at + rng.randrange(0, 30), rng.choice(["", " new", "x", "\n", " 's", "endoftext|>", "<|"]))
            assert tree.total == len(own.encode(tree.text))
            for sums in (tree.lengths, tree.counts):
                assert all(sums[i] == sums[2 * i] + sums[2 * i + 1] for i in range(1, tree.size))
            assert tree.lengths[1] == len(tree.text)


def test_an_edit_touches_a_part_only(both):
    own, _ = both
    tree = token_counts.build(own, "one two three four " * 2000)
    after = token_counts.edit(own, tree, 20_000, 20_004, "five")
    assert after.encoded < 500 < tree.encoded


def test_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the cat 's", "x"), (3, "the cat 's", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = [(r.doc_id, r.n_tokens) for r in bpe.round_trip(df).orderBy("doc_id").collect()]
    assert got[:2] == [(1, 0), (2, 0)] and got[2] == got[3] and got[2][1] > 0
    assert bpe.round_trip(df.limit(0)).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(df)).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == ["", "", "the cat 's", "the cat 's"]
    edits = df.selectExpr("doc_id", "text", "array(named_struct('at', 0, 'gone', 3, 'new', 'a')) edits")
    assert [r.n_tokens_edited > 0 for r in token_counts.count_edited(edits).collect()] == [True] * 4
    assert token_counts.trees(df).count() == 4


def test_op2_on_the_driver_table(spark, both):
    """Every count before and after the query's edits is that of the whole text counted anew."""
    own, _ = both
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op2_token_counts(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r.doc_id]
        n = len(text)
        assert r.n_tokens == len(own.encode(text))
        # As the query has them: a cut in the middle, a word at the start, a new end; places are those of the first text.
        for at, gone, new in ((n // 2, 7, ""), (0, 0, "Revised: "), (n - 12, 20, ".")):
            at = max(0, min(at, len(text)))
            end = max(at, min(at + gone, len(text)))
            text = text[:at] + new + text[end:]
        assert r.n_tokens_edited == len(own.encode(text)), r.doc_id


def test_trees_are_kept_and_edited(spark, both):
    """A stored tree is edited without its text being counted again; null edits, nulls, repeated rows and empty tables."""
    own, _ = both
    rows = [(1, "one two three four " * 900, [(5, 3, "six"), (16_000, 2, "")]), (2, None, [(0, 0, "new words")]), (3, "as it is", None), (3, "as it is", None), (4, "", [])]
    df = spark.createDataFrame(rows, "doc_id int, text string, edits array<struct<at int, gone int, new string>>")
    kept = token_counts.trees(df).cache()
    after = sorted(token_counts.edit_trees(kept).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in after] == [1, 2, 3, 3, 4]
    assert all(r.n_tokens == len(own.encode(r.text)) == r.counts[1] and r.lengths[1] == len(r.text) for r in after)
    assert 0 < after[0].n_words_again < after[0].n_words / 4 and after[2].n_words_again == 0 and after[1].text == "new words"
    again = token_counts.edit_trees(spark.createDataFrame(after).drop("n_tokens_before", "n_words_again").withColumn("edits", F.lit(None).cast(df.schema["edits"].dataType)))
    assert sorted((r.doc_id, r.n_tokens) for r in again.collect()) == [(r.doc_id, r.n_tokens) for r in after]
    assert token_counts.edit_trees(kept.limit(0)).count() == 0


def test_growing_and_shrinking(both):
    own, _ = both
    tree = token_counts.build(own, "word " * 500)
    before = tree.size
    tree = token_counts.edit(own, tree, 1000, 1000, "more of it " * 4000)
    assert tree.size > before and tree.total == len(own.encode(tree.text))
    tree = token_counts.edit(own, tree, 10, len(tree.text) - 10, "")
    assert tree.total == len(own.encode(tree.text))
    for _ in range(300):
        tree = token_counts.edit(own, tree, 5, 5, " ab")
    assert tree.total == len(own.encode(tree.text))


def test_op1_query_against_the_library(spark):
    """ids_sha256 and decoded_sha256 of the query itself."""
    import hashlib
    import struct

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    library.no_truncation(), library.no_padding()
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_bpe(spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
