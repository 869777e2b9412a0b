"""Operator 10: language by character n-grams.

TF-IDF over hashed n-grams of 1 to 3 characters (lower case; runs of anything but letters
are one blank), scaled to unit length, go into a multinomial logistic regression. It is
fitted by follow-the-regularised-leader with elastic-net penalties, so that most weights are
exactly 0; a temperature fitted on a part kept back calibrates its probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _sample
from ._spark import by_slice
from ._words import column_bytes

#: Width of the hashed feature space, longest n-gram.
WIDTH, LONGEST_GRAM = 1 << 14, 3
#: Step size, smoothing, L1 and L2 of the fit, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.02, 4
UNKNOWN = "und"

_folded: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Lower case of every letter, 0 for all that is none, for all code points."""
    if not _folded:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folded.append(table)
    return _folded[0]


def letters(column: pa.Array) -> list[np.ndarray]:
    """For each row its folded letters, with 0 for each run of anything else and at both ends."""
    data, offsets = column_bytes(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = heads[offsets]
    folded = _fold_table()[points]
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = np.concatenate([[0], folded[a:b], [0]]).astype(np.uint32)
        keep = np.ones(len(own), bool)
        keep[1:] = (own[1:] != 0) | (own[:-1] != 0)
        out.append(own[keep])
    return out


def counts(own: np.ndarray) -> np.ndarray:
    """Occurrences of each hashed n-gram."""
    found = []
    code = np.zeros(len(own), np.uint32)
    for n in range(1, LONGEST_GRAM + 1):
        if len(own) < n:
            break
        code = (code[: len(own) - n + 1] * np.uint32(0x01000193)) ^ (own[n - 1 :] * np.uint32(0x85EBCA6B))
        mixed = (code ^ np.uint32(n)) * np.uint32(0x9E3779B1)
        found.append(mixed >> np.uint32(32 - 14))
    return np.bincount(np.concatenate(found), minlength=WIDTH) if found else np.zeros(WIDTH, int)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def features(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tf = counts(own)
        at = np.flatnonzero(tf)
        x = np.log1p(tf[at]) * self.idf[at]
        norm = np.sqrt((x * x).sum())
        return at, (x / norm if norm else x)

    def predict(self, own: np.ndarray) -> tuple[str, float]:
        if not self.langs or not own.any():
            return UNKNOWN, 0.0
        at, x = self.features(own)
        p = softmax((x @ self.weights[at] + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[str, str]]) -> Model:
    """Fits on (text, lang) rows; without rows every prediction is ``und``."""
    kept = [(own, lang) for own, (_, lang) in zip(letters(pa.array([t for t, _ in rows], pa.large_string())), rows, strict=True) if own.any()] if rows else []
    langs = sorted({lang for _, lang in kept})
    model = Model(langs, np.ones(WIDTH), np.zeros((WIDTH, max(1, len(langs)))), np.zeros(max(1, len(langs))), 1.0)
    if not kept:
        return model
    df = np.zeros(WIDTH)
    for own, _ in kept:
        df += counts(own) > 0
    model.idf = np.log((1 + len(kept)) / (1 + df)) + 1
    xs, ys = [model.features(own) for own, _ in kept], np.array([langs.index(lang) for _, lang in kept])
    back = np.arange(len(xs)) % 5 == 4 if len(xs) >= 50 else np.zeros(len(xs), bool)
    z, n = np.zeros((WIDTH + 1, len(langs))), np.zeros((WIDTH + 1, len(langs)))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) > L1, w, 0.0)

    rng = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in rng.permutation(np.flatnonzero(~back)):
            at, x = np.append(xs[i][0], WIDTH), np.append(xs[i][1], 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[ys[i]] -= 1
            g = x[:, None] * p
            squared = n[at] + g * g
            z[at] += g - (np.sqrt(squared) - np.sqrt(n[at])) / ALPHA * w
            n[at] = squared
    every = weights(np.arange(WIDTH + 1))
    model.weights, model.bias = every[:-1], every[-1]
    kept_back = np.flatnonzero(back)
    if len(kept_back):
        logits = np.array([xs[i][1] @ model.weights[xs[i][0]] + model.bias for i in kept_back])
        loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(kept_back)), ys[kept_back]], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.02, 5, 60), key=loss))
    return model


def train(docs: DataFrame, n: int = _sample.ROWS) -> Model:
    """On a bounded sample of the rows outside the held-out fold."""
    rows = docs.where((_sample.fold(4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    found = _sample.draw(rows.select("doc_id"), n)
    texts = docs.where((_sample.fold(4) != 2) & F.col("lang").isNotNull() & (F.char_length("text") <= _sample.LONGEST)).select("doc_id", "text", "lang")
    drawn = texts.join(F.broadcast(found), "doc_id").limit(4 * n).collect()
    return fit([(r["text"], r["lang"]) for r in sorted(drawn, key=lambda r: (r["doc_id"], r["text"]))])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, lang_pred, score. Null texts and texts without a letter: ``und`` and 0."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.predict(own) for own in letters(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return by_slice(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs)).select("doc_id", (_sample.fold(4) == 2).alias("held_out"), "lang_pred", "score")
