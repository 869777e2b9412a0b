"""Operator 8: toxic passages as maximal scoring segments.

The tokens of a word are the word itself and its beginnings of ``STEMS`` bytes, so that
inflected and compound forms tell too. Tokens get log-odds between toxic and clean documents
under a symmetric Dirichlet prior. A word has the score of its most toxic token, or, where
none is, of its most clean one; words whose tokens could all be chance (|z| below ``Z``) or are
new cost ``DRIFT``. Ruzzo and Tompa's linear scan finds every maximal segment of a document. The best
scores of clean documents follow an extreme-value law, fitted here; each segment gets its
expected number of equals by chance in a document of that length, and a document's segments
are combined and mapped to a probability by a logistic fit on the sample.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _sample
from ._spark import by_slice
from ._words import NOT_ALNUM, Words, column_bytes, mix, words

#: Prior count of every token in either class, least z-score (of either sign) of a telling token, cost of any other word.
PRIOR, Z, DRIFT = 0.5, 3.2, 0.02
#: Lengths in bytes of the beginnings of words that are tokens.
STEMS = (3, 4, 5, 6, 7, 8)
#: Documents in which a token must occur to tell, and its least log-odds.
SPREAD, ODDS = 5, 1.5
#: Segments whose chance count lies below this are significant.
SIGNIFICANT = 0.05


@dataclass
class Model:
    keys: np.ndarray
    scores: np.ndarray
    rate: float
    size: float
    slope: float
    offset: float

    def word_scores(self, tokens: np.ndarray) -> np.ndarray:
        """A score for each column of ``tokens`` (rows: the word and its beginnings)."""
        high, low = np.zeros(tokens.shape[1]), np.full(tokens.shape[1], -DRIFT)
        if len(self.keys):
            for hashed in tokens:
                at = np.minimum(np.searchsorted(self.keys, hashed), len(self.keys) - 1)
                own = np.where(self.keys[at] == hashed, self.scores[at], 0.0)
                high, low = np.maximum(high, own), np.minimum(low, own)
        return np.where(high > 0, high, low)

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """The log of the chance count of the segments together, negated: 0 where there are none."""
        each = [max(0.0, self.rate * s - math.log(self.size * max(n, 1))) for _, _, s in segments]
        return sum(sorted(each, reverse=True)) if each else 0.0

    def significant(self, score: float, n: int) -> bool:
        return self.rate * score - math.log(self.size * max(1, n)) > -math.log(SIGNIFICANT)

    def probability(self, segments: list[tuple[int, int, float]], n: int) -> float:
        best = max((s for _, _, s in segments), default=0.0)
        x = self.evidence(segments, n) + 0.5 * self.rate * best
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * x + self.offset))))


def tokens(found: Words) -> np.ndarray:
    """Hashes of the words and, below them, of their beginnings (0 where a word is no longer)."""
    out = [found.hash]
    for n in STEMS:
        longer = found.end - found.start > n
        out.append(np.where(longer, mix(found.prefix(n, longer) + np.uint64(n)), np.uint64(0)))
    return np.stack(out)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), left to right, in linear time."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # start, end, sum before, sum after
    below: list[int] = []  # for each entry, the nearest earlier one with a smaller sum before
    runs = np.flatnonzero(np.diff(positive, prepend=-2) > 1)
    for first, last in zip(positive[runs], positive[np.append(runs[1:], len(positive)) - 1], strict=True):
        start, low, end, high = int(first), sums[first], int(last) + 1, sums[last + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = below[j]
            if j < 0 or found[j][3] >= high:
                found.append([start, end, low, high])
                below.append(j)
                break
            start, low = found[j][0], found[j][2]
            del found[j:], below[j:]
    return [(a, b, float(high - low)) for a, b, low, high in found]


def fit(rows: list[tuple[str, int]]) -> Model:
    """Fits on (text, toxic) rows; with one class only, everything scores alike."""
    rows = [(t, y) for t, y in rows if t]
    labels = np.array([y for _, y in rows], bool)
    texts, seen = [t for t, _ in rows], []
    for at in range(0, len(texts), 200):
        found = words(pa.array(texts[at : at + 200], pa.large_string()), NOT_ALNUM)
        held, bounds = tokens(found), found.bounds()
        seen += [np.unique(held[:, a:b][held[:, a:b] != 0]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    none = [np.zeros(0, np.uint64)]
    count = lambda wanted: np.unique(np.concatenate([x for x, y in zip(seen, labels, strict=True) if y == wanted] or none), return_counts=True)
    (own, n_own), (others, n_others) = count(True), count(False)
    keys = np.union1d(own, others)
    toxic, clean = np.zeros(len(keys)), np.zeros(len(keys))
    toxic[np.searchsorted(keys, own)], clean[np.searchsorted(keys, others)] = n_own, n_others
    del seen
    nt, nc = float(toxic.sum()), float(n_others.sum())
    if not nt or not nc:
        p = float(labels.mean()) if len(labels) else 0.0
        return Model(keys[:0], np.zeros(0), 1.0, 1.0, 0.0, math.log((p + 0.01) / (1.01 - p)))
    most = PRIOR * (len(own) + len(others))
    odds = np.log((toxic + PRIOR) / (nt + most - toxic - PRIOR)) - np.log((clean + PRIOR) / (nc + most - clean - PRIOR))
    z = odds / np.sqrt(1 / (toxic + PRIOR) + 1 / (clean + PRIOR))
    telling = (np.abs(z) > Z) & (np.abs(odds) > ODDS) & (np.where(odds > 0, toxic, clean) >= SPREAD)
    model = Model(keys[telling], odds[telling], 1.0, 1.0, 1.0, 0.0)
    scored, lengths = [], []
    for at in range(0, len(texts), 200):
        found = words(pa.array(texts[at : at + 200], pa.large_string()), NOT_ALNUM)
        every, bounds = model.word_scores(tokens(found)), found.bounds()
        scored += [segments(every[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        lengths += [int(n) for n in np.diff(bounds)]
    best = np.array([max((s for _, _, s in x), default=0.0) for x in scored])
    null = best[~labels]
    # Gumbel by moments; where clean documents hold no telling word, a unit rate stands in.
    spread_of = float(np.std(null)) if len(null) > 1 else 0.0
    model.rate = min(2.0, math.pi / (math.sqrt(6) * spread_of)) if spread_of > 0 else 1.0
    centre = float(np.mean(null)) - 0.5772 / model.rate if len(null) else 0.0
    model.size = min(1.0, max(1e-6, math.exp(model.rate * centre) / max(1.0, float(np.median(lengths)))))
    x = np.array([model.evidence(s, n) + 0.5 * model.rate * b for s, n, b in zip(scored, lengths, best, strict=True)])
    model.slope, model.offset = _logistic(x, labels.astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """One-feature logistic regression by damped Newton steps."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(2), a.T @ (y - p) - 0.05 * w)
        w += np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, n: int = _sample.ROWS) -> Model:
    return fit(_sample.labelled(docs, labels, "toxic", _sample.fold(4) != 2, n))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, score, spans, n_significant.

    A span is a passage: start and end in words, score, whether it is significant, and its text.
    Null and empty texts have no passages and score as clean ones. Repeated rows repeat.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("significant", pa.bool_()), ("text", pa.string())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = words(batch.column("text"), NOT_ALNUM)
        data, _ = column_bytes(batch.column("text"))
        bounds, scores = found.bounds(), model.word_scores(tokens(found))
        out, spans, telling = [], [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = segments(scores[a:b])
            out.append(model.probability(own, int(b - a)))
            held = []
            for start, end, value in own:
                text = data[found.start[a + start] : found.end[a + end - 1]].tobytes().decode("utf-8", "replace")
                held.append({"start": start, "end": end, "score": value, "significant": model.significant(value, int(b - a)), "text": text})
            spans.append(held)
            telling.append(sum(x["significant"] for x in held))
        made = [batch.column("doc_id"), pa.array(out, pa.float64()), pa.array(spans, kind), pa.array(telling, pa.int32())]
        return pa.RecordBatch.from_arrays(made, names=["doc_id", "score", "spans", "n_significant"])

    span = "struct<start int, end int, score double, significant boolean, text string>"
    return by_slice(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, f"doc_id long, score double, spans array<{span}>, n_significant int")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The scores with their fold and decision, and the significant passages' texts in their order."""
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        (_sample.fold(4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
        "n_significant",
        F.transform(F.filter("spans", lambda x: x["significant"]), lambda x: x["text"]).alias("passages"),
    )
