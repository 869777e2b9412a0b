"""Operator 5: benchmark passages in documents, re-parameterised ones too.

Words become a template: numbers, names and units are typed placeholders. Windows of
``WINDOW`` template words (the whole template where an item is shorter) are joined by hash
between items and documents. On each diagonal (document place less item place) the values
in the slots must be consistent: one value of the item always stands for one value of the
document.

What decides are the words that the joined windows cover, not the windows: diagonals of one
region, as wide as the item is long, are taken together, so changed, dropped and inserted words
cost the words about them and no more. A document leaks an item if in one region the windows
cover ``COVER`` of the item's words, or a run of ``RUN`` words without a break. Words of an item
that no window holds, for their slots stand too close, don't count, but for half of the
item at least its words must count.

Only windows that some item has leave a document's task. The items' hashes go to all tasks
while they number at most ``HASHES`` (8 bytes each); beyond that every window is shuffled and
joined. Null and empty texts and items match nothing. Texts that share an item_id are looked
for one by one.

A second pass looks for verbatim copies: all words are literals in lower case, so neither capitals
nor slots matter, and items of any length, of ``LEAST`` words or fewer too, have windows. Letters of
scripts without blanks (``UNSPACED``) count as words there. Names are slots by their capitals, so
templates of items of fewer than ``LEAST`` words, and copies with other values whose case differs
as well, are not looked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import by_slice
from ._words import NOT_ALNUM, column_bytes, hash_word, shingles, words

#: Template words in a window; of them literal at least; least words of an item; share of an item's words; words of a quote.
WINDOW, LITERAL, LEAST, COVER, RUN = 6, 3, 5, 0.5, 25
#: Window hashes that are broadcast at most (16 MB).
HASHES = 2_000_000

# Number words and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split()
UNIT_WORDS = (
    "mm cm m km inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers centimetre centimetres centimeter centimeters "
    "mg g kg gram grams kilogram kilograms tonne tonnes ton tons ounce ounces pound pounds lb lbs ml l litre litres liter liters gallon gallons cup cups "
    "second seconds minute minutes hour hours day days week weeks month months year years am pm "
    "cent cents dollar dollars euro euros usd eur percent degree degrees celsius fahrenheit kelvin joule joules watt watts volt volts mph kph hz khz mhz ghz kb mb gb tb"
).split()
#: Words that are no names where a sentence begins with them.
PLAIN_WORDS = "a an and are as at be both but by can did do does each every find for from given had has have he her his how i if in is it its let many much my no not of on one or our she so some suppose that the their then there these they this those to was we were what when where which while who whose why will with you your".split()
NUMBER, NAME, UNIT = (hash_word(f"\x00{kind}") for kind in ("number", "name", "unit"))
#: Scripts that part no words by blanks.
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
SCHEMA = "place int, hash long, slots array<long>, size int"


def _hashes(some: list[str]) -> np.ndarray:
    return np.sort(np.array([hash_word(w) for w in some], np.uint64))


_NUMBERS, _UNITS, _PLAIN = _hashes(NUMBER_WORDS), _hashes(UNIT_WORDS), _hashes(PLAIN_WORDS)


def _among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(values), bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


def template(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every template word of the column: row, template hash, value hash, whether it is a slot."""
    raw = words(column, NOT_ALNUM, lower=True)
    data, _ = column_bytes(column)
    first = data[raw.start] if len(raw.start) else np.zeros(0, np.uint8)
    at = lambda n: data[np.minimum(raw.start + n, raw.end - 1)] if len(raw.start) else first
    long = raw.end - raw.start
    ascii_upper = (first >= 65) & (first <= 90) & (long > 1) & ~((at(1) >= 65) & (at(1) <= 90))
    wide_upper = (first == 0xC3) & (at(1) >= 0x80) & (at(1) <= 0x9E) & (long > 2) & (at(2) >= 97) & (at(2) <= 122)
    digit = (first >= 48) & (first <= 57)
    number = digit | _among(raw.hash, _NUMBERS)
    unit = _among(raw.hash, _UNITS) & ~number
    name = (ascii_upper | wide_upper) & ~number & ~unit & ~_among(raw.hash, _PLAIN)
    # Digits parted by one mark (1,000 or 3.5) are one number.
    joined = np.zeros(len(digit), bool)
    joined[1:] = digit[1:] & digit[:-1] & (raw.row[1:] == raw.row[:-1]) & (raw.start[1:] == raw.end[:-1] + 1) & np.isin(data[raw.end[:-1].clip(max=max(0, len(data) - 1))], [44, 46])
    keep = np.flatnonzero(~joined)
    value = np.add.reduceat(raw.hash, keep) if len(keep) else raw.hash[:0]
    hashed = np.where(number, np.uint64(NUMBER), np.where(name, np.uint64(NAME), np.where(unit, np.uint64(UNIT), raw.hash)))[keep]
    return raw.row[keep], hashed, value, (number | name | unit)[keep]


def literals(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``template``, but all words are literals, whatever their case."""
    raw = words(pc.replace_substring_regex(pc.utf8_lower(column), UNSPACED, r" \1 "), NOT_ALNUM, lower=True)
    return raw.row, raw.hash, raw.hash, np.zeros(len(raw.hash), bool)


def windows(column: pa.Array, sizes: list[int], wanted: np.ndarray | None, form=template) -> tuple[np.ndarray, list, list, list, list]:
    """(row, place, hash, slots, size) of all windows, or of those with a hash in ``wanted``."""
    row, hashed, value, slot = form(column)
    literal = np.concatenate([[0], np.cumsum(~slot)])
    first = np.searchsorted(row, np.arange(len(column)))
    out = [np.zeros(0, np.int64)], [], [], [], []
    for size in sizes:
        if len(row) < size:
            continue
        keys = shingles(hashed, size)
        n = len(keys)
        good = (row[:n] == row[size - 1 :]) & (literal[size:] - literal[:n] >= min(LITERAL, size - 1))
        if wanted is not None:
            good &= _among(keys, wanted)
        for i in np.flatnonzero(good):
            out[0].append(row[i : i + 1])
            out[1].append(int(i - first[row[i]]))
            out[2].append(int(keys[i].astype(np.int64)))
            out[3].append(value[i : i + size][slot[i : i + size]].astype(np.int64).tolist())
            out[4].append(size)
    return np.concatenate(out[0]), *out[1:]


def _window_rows(df: DataFrame, key: str, sizes: list[int], wanted: np.ndarray | None, form) -> DataFrame:
    kind = pa.list_(pa.int64())

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, place, hashed, slots, size = windows(batch.column("text"), sizes, wanted, form)
        return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), pa.array(place, pa.int32()), pa.array(hashed, pa.int64()), pa.array(slots, kind), pa.array(size, pa.int32())], names=[key, "place", "hash", "slots", "size"])

    return by_slice(df.select(key, "text"), work, f"{key} {df.schema[key].dataType.simpleString()}, {SCHEMA}")


def _item_windows(items: DataFrame, form, least: int) -> DataFrame:
    """All windows of all items: of WINDOW words, or of the whole item where it is shorter. ``part`` tells texts of one id apart, ``n`` counts a text's words."""
    kind = pa.list_(pa.int64())

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text")
        row = form(column)[0]
        n = np.bincount(row, minlength=len(column)) if len(column) else np.zeros(0, int)
        held = [[], [], [], [], []]
        for i in range(len(column)):
            if n[i] >= least:
                size = int(min(WINDOW, n[i]))
                _, place, hashed, slots, sizes = windows(column.slice(i, 1), [size], None, form)
                for to, more in zip(held, ([i] * len(place), place, hashed, slots, sizes), strict=True):
                    to += more
        at = pa.array(held[0], pa.int64())
        made = [batch.column("item_id").take(at), batch.column("part").take(at), pa.array(n, pa.int32()).take(at)]
        made += [pa.array(held[1], pa.int32()), pa.array(held[2], pa.int64()), pa.array(held[3], kind), pa.array(held[4], pa.int32())]
        return pa.RecordBatch.from_arrays(made, names=["item_id", "part", "n", "place", "hash", "slots", "size"])

    own = items.where("text is not null and item_id is not null").dropDuplicates(["item_id", "text"])
    own = own.select("item_id", F.xxhash64("text").alias("part"), "text")
    return by_slice(own, work, f"item_id {items.schema['item_id'].dataType.simpleString()}, part long, n int, {SCHEMA}")


def leaks(docs: DataFrame, items: DataFrame, most_hashes: int = HASHES) -> DataFrame:
    """Leaked pairs: doc_id, item_id, n_words, n_item_words, longest_run, coverage, same_values.

    ``n_words`` of the item's ``n_item_words`` words stand in the document, ``longest_run`` of them without
    a break. ``same_values``: every slot holds the item's own value. Repeated documents with one doc_id
    count as one document. A pair that leaks in several ways has the figures of the one that covers most.
    """
    both = _leaks(docs, items, most_hashes, template, LEAST).unionByName(_leaks(docs, items, most_hashes, literals, 1))
    best = both.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("coverage", "n_words", "n_item_words", "longest_run")).alias("best"), F.bool_or("same_values").alias("same_values")
    )
    return best.select("doc_id", "item_id", "best.n_words", "best.n_item_words", "best.longest_run", "best.coverage", "same_values")


def _covered(places: Column, size: Column) -> Column:
    """The different words that windows at these places cover."""
    return F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + size - 1))))


def _run(places: Column, size: Column) -> Column:
    """The most words in a row that windows at these places cover."""
    start = F.struct(F.lit(0).alias("begin"), F.lit(-1).alias("end"), F.lit(0).alias("best"))

    def step(held: Column, p: Column) -> Column:
        begin = F.when(p <= held["end"], held["begin"]).otherwise(p)
        return F.struct(begin.alias("begin"), (p + size).alias("end"), F.greatest(held["best"], p + size - begin).alias("best"))

    return F.aggregate(F.array_sort(places), start, step, lambda held: held["best"])


def _leaks(docs: DataFrame, items: DataFrame, most_hashes: int, form, least: int) -> DataFrame:
    """The leaked pairs by the windows of one form."""
    item = _item_windows(items, form, least).cache()
    text = ["item_id", "part", "n"]
    counted = F.size(_covered(F.collect_set("place"), F.first("size")))
    totals = item.groupBy(text).agg(F.greatest(counted, F.ceil(F.col("n") / 2)).cast("long").alias("n_item_words"))
    n = item.count()
    sizes = sorted(r[0] for r in item.select("size").distinct().collect())
    small = n <= most_hashes
    wanted = None
    if small:
        wanted = np.unique(np.array([r[0] for r in item.select("hash").distinct().collect()], np.int64).astype(np.uint64))
    own = _window_rows(docs.where("text is not null"), "doc_id", sizes or [WINDOW], wanted, form)
    right = item.select(*text, F.col("place").alias("item_place"), "hash", F.col("slots").alias("item_slots"), "size")
    met = own.join(F.broadcast(right) if small else right, ["hash", "size"])
    pairs = F.arrays_zip("item_slots", "slots")
    # One text's windows have one size.
    diagonal = (
        met.groupBy("doc_id", *text, (F.col("place") - F.col("item_place")).alias("diagonal"))
        .agg(F.first("size").alias("size"), F.collect_set("item_place").alias("at"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
        .where(F.size(F.array_distinct(F.transform("pairs", lambda x: x["item_slots"]))) == F.size("pairs"))
        .withColumn("same", F.forall("pairs", lambda x: x["item_slots"] == x["slots"]))
        .withColumn("run", _run(F.col("at"), F.col("size")))
    )
    # Regions overlap by half, so that a copy whose diagonals shift lies within one.
    region = F.explode(F.array(F.floor(2 * F.col("diagonal") / F.col("n")), F.floor(2 * F.col("diagonal") / F.col("n")) - 1))
    found = (
        diagonal.withColumn("region", region)
        .groupBy("doc_id", *text, "region")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_set(_covered(F.col("at"), F.col("size")))))).cast("long").alias("n_words"),
            F.max("run").cast("long").alias("longest_run"),
            F.bool_and("same").alias("same_values"),
        )
    )
    return (
        found.join(F.broadcast(totals) if small else totals, text)
        .withColumn("coverage", F.least(F.lit(1.0), F.col("n_words") / F.col("n_item_words")))
        .where((F.col("coverage") >= COVER) | (F.col("longest_run") >= RUN))
        .select("doc_id", "item_id", "n_words", "n_item_words", "longest_run", "coverage", "same_values")
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak an item; rows without doc_id stay."""
    return docs.join(leaks(docs, items).select("doc_id").distinct(), "doc_id", "left_anti")
