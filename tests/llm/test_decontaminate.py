import re

from graphloom.llm import decontaminate, queries

ITEM = "Tom has 12 apples and gives 5 of them to Anna. How many apples does Tom keep after 3 days of eating one each day?"


def test_planted_items(spark):
    """Brute force over the driver's tables: documents that hold an item's words in a row."""
    sf = "/root/testdata/sf0.01"
    split = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [(r.item_id, f" {split(r.text)} ") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, f" {split(r.text)} ") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(d, i) for d, text in docs for i, item in items if item in text}
    got = {(r.doc_id, r.item_id): r for r in queries.op5_decontaminate(spark, sf).collect()}
    assert want and want <= set(got)
    assert all(r.same_values for k, r in got.items() if k in want)
    assert len(set(got) - want) <= 2


def test_changed_parameters(spark):
    same = ITEM
    changed = ITEM.replace("Tom", "Maria").replace("12", "1,250").replace("days", "weeks").replace("Anna", "Paul")
    mixed = changed.replace("does Maria", "does Paul").replace("gives 5", "gives 6")
    other = "Tom has 12 pears and wants 5 of those for Anna, which of the friends will run after them on Monday?"
    docs = [(1, f"Before. {same} After."), (2, f"Before it {changed}"), (3, mixed), (4, other), (5, None), (6, ""), (7, "x " * 50_000 + changed), (7, "x " * 50_000 + changed)]
    docs = spark.createDataFrame([(i, t, "s", "h") for i, t in docs], "doc_id long, text string, item_id string, hash string")
    items = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, None), (12, ""), (13, "two words"), (None, ITEM)], "item_id long, text string")
    for most in (decontaminate.HASHES, 3):
        got = {r.doc_id: (r.item_id, r.same_values) for r in decontaminate.leaks(docs, items, most).collect()}
        assert got[1] == (10, True) and got[2] == got[7] == (10, False) and set(got) == {1, 2, 7}
    assert decontaminate.leaks(docs, items.limit(0)).count() == decontaminate.leaks(docs.limit(0), items).count() == 0
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [3, 4, 5, 6]


def test_short_items_match_whole(spark):
    docs = spark.createDataFrame([(1, "so the quick brown fox jumps here"), (2, "the quick brown dog jumps")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "The quick brown fox jumps")], "item_id long, text string")
    got = decontaminate.leaks(docs, items).collect()
    assert [r.doc_id for r in got] == [1]


def test_verbatim_in_any_case(spark):
    """A copy in lower case or capitals is the item, though its names are no slots there."""
    item = "Tom Baker met Anna Weiss, Paul Stone, Maria Lopez and Émile Ünal in Paris. Tom gave Anna 12 red apples. Paul gave Émile 7."
    docs = spark.createDataFrame([(1, f"so {item.lower()} end"), (2, item.upper()), (3, "nothing of it is in here at all")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {(r.doc_id, r.same_values) for r in decontaminate.leaks(docs, items).collect()} == {(1, True), (2, True)}


def test_short_and_slotted_items(spark):
    """Whole items are found verbatim however short or full of slots, and without blanks between words."""
    texts = {1: "Where was Albert Einstein born", 2: "What is 12 + 30 + 7", 3: "Boil two eggs", 4: "法国的首都是哪里"}
    rows = [(i, f"Before it: {t}. After it.") for i, t in texts.items()] + [(4 + 1, "他问法国的首都是哪里然后走了"), (6, "What is 12 + 31 + 7"), (7, "Where was Albert"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, spark.createDataFrame(list(texts.items()), "item_id long, text string")).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4)}


def test_near_copies_and_quotes(spark):
    """A changed word every eight words, dropped and inserted words, and a quote of less than half of an item."""
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su", "ka") for b in ("ban", "der", "fil", "gor", "hum", "jas", "kel", "lom", "nip", "pur", "qua")]
    item = " ".join(words[:64])
    changed = " ".join("other" if i % 8 == 4 else w for i, w in enumerate(words[:64]))
    shifted = " ".join(w for i, w in enumerate(words[:64]) for w in ([w, "more"] if i % 9 == 7 else [] if i % 20 == 19 else [w]))
    short = " ".join(words[:16])
    docs = {
        1: f"before it {changed} after it",
        2: f"before it {shifted} after it",
        3: "x y z " * 30 + " ".join(words[20:50]) + " and so on" * 30,
        4: short.replace(words[8], "other"),
        5: " ".join(words[20:34]) + " nothing else",
        6: " pause ".join(" ".join(words[i : i + 3]) for i in range(0, 63, 3)),
        7: " ".join(" ".join(words[i : i + 6]) + " far" * 200 for i in range(0, 60, 6)),
    }
    docs = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    for most in (decontaminate.HASHES, 3):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, items, most).collect()}
        assert {d for d, i in got if i == 1} == {1, 2, 3} and (4, 2) in got
        assert got[3, 1].longest_run == got[3, 1].n_words == 30 and got[4, 2].n_words == 15
        assert not {d for d, _ in got} & {5, 6}


def test_items_with_several_texts(spark):
    """Each text of an item_id is looked for, alone."""
    one, two = "the first text of the item is about rivers and boats", "a second form speaks of mountains and of the long way up"
    docs = spark.createDataFrame([(1, one), (2, two), (3, one + " " + two)], "doc_id int, text string")
    items = spark.createDataFrame([(1, one), (1, two)], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.coverage) for r in decontaminate.leaks(docs, items).collect()} == {(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)}
