"""Operator 7: quality by a convolutional network over bytes.

Bytes become learned vectors; learned filters of ``WIDTH`` bytes move over the whole text in
steps of ``STEP``; their rectified answers are max-pooled in chunks that overlap by half; a
hidden layer turns each chunk's maxima into a logit, and the mean of a document's chunk logits
gives one probability. Fitted by Adam on a bounded sample, all in numpy.
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

#: Bytes in a half chunk; two neighbours make a chunk.
HALF = 128
#: Size of a byte's vector, bytes in a filter, bytes between filter positions, filters, hidden units.
EMBED, WIDTH, STEP, FILTERS, HIDDEN = 6, 8, 2, 24, 16
#: Passes over the sample, documents in a step, chunks of a document in a step at most (drawn anew each time), rate.
PASSES, BATCH, CHUNKS, RATE = 16, 32, 6, 0.004
#: Rows of the sample, by expectation.
ROWS = 4000
PLACES = HALF // STEP


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    hidden: np.ndarray
    hidden_shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray

    def names(self) -> list[str]:
        return list(self.__dataclass_fields__)


def start(seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    zeros = lambda n: np.zeros(n, np.float32)
    return Network(rng.standard_normal((256, EMBED)).astype(np.float32) * 0.5, draw(WIDTH * EMBED, FILTERS), zeros(FILTERS), draw(FILTERS, HIDDEN), zeros(HIDDEN), draw(HIDDEN, 1), zeros(1))


def padded(data: np.ndarray) -> np.ndarray:
    """A filter's width of 0, the bytes, and 0 up to whole half chunks (two at least) and a width more.

    Laid one after another less that last width, documents don't reach into each other's filters.
    """
    halves = max(2, -(-(len(data) + WIDTH) // HALF))
    out = np.zeros(halves * HALF + WIDTH, np.uint8)
    out[WIDTH : WIDTH + len(data)] = data
    return out


def maxima(net: Network, data: np.ndarray) -> np.ndarray:
    """The filters' maxima in each half chunk of padded bytes."""
    vectors = net.embed[data]
    n = (len(data) - WIDTH) // STEP
    view = np.lib.stride_tricks.as_strided(vectors, (n, WIDTH * EMBED), (STEP * EMBED * 4, 4))
    return (view @ net.filters).reshape(-1, PLACES, FILTERS).max(1)


def chunk_logits(net: Network, halves: np.ndarray) -> np.ndarray:
    """A logit for each pair of neighbouring half chunks."""
    pooled = np.maximum(np.maximum(halves[:-1], halves[1:]) + net.shift, 0)
    return (np.maximum(pooled @ net.hidden + net.hidden_shift, 0) @ net.out + net.out_shift)[:, 0]


def document_scores(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One probability for each row of a column's bytes."""
    pieces = [padded(data[a:b])[:-WIDTH] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    if not pieces:
        return np.zeros(0)
    joined = np.concatenate([*pieces, np.zeros(WIDTH, np.uint8)])
    sizes = np.array([len(p) // HALF for p in pieces])
    ends = np.cumsum(sizes)
    block = 1024 * HALF
    halves = np.concatenate([maxima(net, joined[a : min(a + block, len(joined) - WIDTH) + WIDTH]) for a in range(0, len(joined) - WIDTH, block)])
    logits = chunk_logits(net, halves)
    sums = np.concatenate([[0.0], np.cumsum(np.clip(logits.astype(np.float64), -8, 8))])
    first = ends - sizes
    # A pair that spans two documents (the last half of one, the first of the next) belongs to none.
    mean = (sums[ends - 1] - sums[first]) / (sizes - 1)
    return 1 / (1 + np.exp(-mean))


def fit(rows: list[tuple[str, int]], seed: int = 3, passes: int = PASSES) -> Network:
    """Fits on (text, quality) rows; with one class only, the answer is that class's share."""
    net = start(seed)
    y = np.array([v for _, v in rows], np.float32)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.out_shift[:] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return net
    docs = [padded(np.frombuffer((t or "").encode(), np.uint8)) for t, _ in rows]
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(getattr(net, k)) for k in net.names()}
    second = {k: np.zeros_like(getattr(net, k)) for k in net.names()}
    step, total = 0, passes * -(-len(docs) // BATCH)
    for _ in range(passes):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            chunks, owner = [], []
            for k, i in enumerate(some):
                n = (len(docs[i]) - WIDTH) // HALF - 1
                for c in np.arange(n) if n <= CHUNKS else np.sort(rng.choice(n, CHUNKS, replace=False)):
                    chunks.append(docs[i][c * HALF : (c + 2) * HALF + WIDTH])
                    owner.append(k)
            grads = _gradients(net, np.stack(chunks), np.array(owner), y[some], weight[some])
            step += 1
            rate = RATE * min(1.0, 2 * (1 - step / (total + 1)))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
                setattr(net, k, (getattr(net, k) - rate * move).astype(np.float32))
    return net


def _gradients(net: Network, chunks: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    c, places = len(chunks), 2 * PLACES
    read = np.lib.stride_tricks.sliding_window_view(chunks, WIDTH, axis=1)[:, : places * STEP : STEP]
    view = net.embed[read].reshape(c * places, WIDTH * EMBED)
    answers = (view @ net.filters).reshape(c, places, FILTERS)
    where = answers.argmax(1)
    top = np.take_along_axis(answers, where[:, None], 1)[:, 0] + net.shift
    pooled = np.maximum(top, 0)
    raw = pooled @ net.hidden + net.hidden_shift
    held = np.maximum(raw, 0)
    logit = (held @ net.out + net.out_shift)[:, 0]
    n = np.bincount(owner, minlength=len(y)).astype(np.float32)
    mean = np.bincount(owner, logit, minlength=len(y)) / n
    slope = ((1 / (1 + np.exp(-mean)) - y) * weight / len(y)).astype(np.float32)
    d_logit = (slope / n)[owner][:, None]
    d_raw = (d_logit @ net.out.T) * (raw > 0)
    d_top = (d_raw @ net.hidden.T) * (top > 0)
    d_filters, d_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
    view, rows = view.reshape(c, places, -1), np.arange(c)
    for f in range(FILTERS):
        used = d_top[:, f]
        if used.any():
            d_filters[:, f] = used @ view[rows, where[:, f]]
            back = used[:, None, None] * net.filters[:, f].reshape(1, WIDTH, EMBED)
            np.add.at(d_embed, read[rows, where[:, f]].ravel(), back.reshape(-1, EMBED))
    return {"embed": d_embed, "filters": d_filters, "shift": d_top.sum(0), "hidden": pooled.T @ d_raw, "hidden_shift": d_raw.sum(0), "out": held.T @ d_logit, "out_shift": d_logit.sum(0)}


def train(docs: DataFrame, labels: DataFrame, n: int = ROWS) -> Network:
    return fit(_sample.labelled(docs, labels, "quality", _sample.fold(5) != 0, n))


def score(docs: DataFrame, net: Network, column: str = "quality_score") -> DataFrame:
    """``docs`` with the probability of good quality added.

    Every byte of every text counts; null and empty texts score as a chunk of nothing.
    Repeated rows repeat; other columns pass through.
    """
    rest = [c for c in docs.columns if c != column]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = document_scores(net, *column_bytes(batch.column("text")))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(found, pa.float64())], names=[*rest, column])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return by_slice(docs.select(rest), work, f"{fields}, `{column}` double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels), "score")
    return scored.select("doc_id", (_sample.fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
