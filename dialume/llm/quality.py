"""Text quality by a byte-level convolutional network in numpy.

The whole text is covered by chunks of ``CHUNK`` bytes, each overlapping the next
by half. In a chunk, learned filters of four bytes slide by two bytes and are
max-pooled; fixed lag filters compare each byte with the one ``p`` bytes before,
for every ``p`` up to ``LAGS``, and the best lag's share of matches is pooled (a
repeated word or line matches at its length). Chunks are max-pooled and averaged
over the document, and a logistic layer gives one probability. Filters and layer
are fitted together by gradient descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_view
from .training import labelled_sample

CHUNK, WIDTH, STRIDE, FILTERS, LAGS = 128, 4, 2, 16, 32
HALF = CHUNK // 2
#: Documents to fit on and bytes of their texts (at most), passes over them, documents in a step.
SAMPLE, SAMPLE_BYTES, EPOCHS, STEP = 3000, 16 << 20, 4, 16
#: Bytes laid out at once when scoring.
BUDGET = 1 << 20


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each between ``WIDTH`` and at least ``LAGS``
    zeros, in whole half chunks; and each one's half chunks."""
    halves = np.array([-(-(len(t) + WIDTH + LAGS) // HALF) for t in texts], np.int64)
    data = np.zeros(int(halves.sum()) * HALF, np.uint8)
    at = 0
    for t, n in zip(texts, halves.tolist()):
        data[at + WIDTH : at + WIDTH + len(t)] = np.frombuffer(t, np.uint8)
        at += n * HALF
    return data, halves


def lag_matches(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each half chunk: matches at every lag, and its bytes of text."""
    full = (data != 0).reshape(-1, HALF)
    out = np.zeros((len(full), LAGS), np.float32)
    for p in range(1, LAGS + 1):
        same = np.zeros(len(data), bool)
        np.equal(data[p:], data[:-p], out=same[p:])
        out[:, p - 1] = (same.reshape(-1, HALF) & full).sum(1)
    return out, full.sum(1)


def lag_features(data: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """Per document: the largest and the mean share of matches of a chunk's best lag."""
    matches, size = lag_matches(data)
    first = np.cumsum(halves) - halves
    ends = np.zeros(len(size), bool)
    ends[first + halves - 1] = True
    after = np.where(ends[:, None], 0, np.r_[matches[1:], matches[:1]])
    n = size + np.where(ends, 0, np.r_[size[1:], size[:1]])
    share = (matches + after).max(1) / np.maximum(n, 32)
    weight = n / np.maximum(np.add.reduceat(n, first), 1)[np.repeat(np.arange(len(halves)), halves)]
    return np.stack([np.maximum.reduceat(share, first), np.add.reduceat(share * weight, first)], 1).astype(np.float32)


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    layer: np.ndarray  # over max-pooled, mean-pooled and lag features
    offset: float

    def convolve(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled responses of every half chunk, and the places they come from."""
        padded = np.r_[data, np.zeros(WIDTH, np.uint8)]
        out = self.filters[0][padded[: len(data) : STRIDE]]
        for j in range(1, WIDTH):
            out += self.filters[j][padded[j : j + len(data) : STRIDE]]
        out = out.reshape(-1, HALF // STRIDE, FILTERS)
        return out, out.max(1) + self.bias

    def pool(self, halves_max: np.ndarray, halves: np.ndarray, lags: np.ndarray) -> np.ndarray:
        first = np.cumsum(halves) - halves
        act = np.maximum(halves_max, 0)
        ends = np.zeros(len(act), bool)
        ends[first + halves - 1] = True
        chunk = np.where(ends[:, None], act, np.maximum(act, np.r_[act[1:], act[:1]]))
        return np.concatenate([np.maximum.reduceat(chunk, first), np.add.reduceat(chunk, first) / halves[:, None], lags], 1)

    def predict(self, texts: list[bytes]) -> np.ndarray:
        data, halves = lay_out(texts)
        _, top = self.convolve(data)
        x = self.pool(top, halves, lag_features(data, halves)) @ self.layer + self.offset
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    return Network((rng.normal(size=(WIDTH, 256, FILTERS)) * 0.3).astype(np.float32), np.zeros(FILTERS, np.float32), (rng.normal(size=2 * FILTERS + 2) * 0.1).astype(np.float32), 0.0)


def fit(docs: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on the log loss. Without documents of both labels every score is the
    share of good ones (one half without any)."""
    net = start(seed)
    share = sum(y for _, y in docs) / len(docs) if docs else 0.5
    if share in (0.0, 1.0) or not docs:
        net.layer[:] = 0
        net.offset = float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -30, 30))
        return net
    net.offset = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    texts, labels = [t.encode() for t, _ in docs], np.array([y for _, y in docs], np.float32)
    weights = [net.filters, net.bias, net.layer, np.array([net.offset], np.float32)]
    means, squares, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    epochs = max(epochs, min(40, 300 * STEP // len(docs) + 1))
    steps = epochs * -(-len(docs) // STEP)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), STEP):
            some = order[at : at + STEP]
            grads = _gradients(net, [texts[i] for i in some], labels[some])
            t += 1
            rate = 0.01 * (1 - 0.9 * t / steps)
            for w, g, m, s in zip(weights, grads, means, squares):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
            net.offset = float(weights[3][0])
    return net


def _gradients(net: Network, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    data, halves = lay_out(texts)
    raw, top = net.convolve(data)
    lags = lag_features(data, halves)
    x = net.pool(top, halves, lags)
    p = 1 / (1 + np.exp(-np.clip(x @ net.layer + net.offset, -30, 30)))
    miss = ((p - y) / len(y)).astype(np.float32)
    d_layer, d_x = x.T @ miss, miss[:, None] * net.layer
    # through the pools to half chunks
    first = np.cumsum(halves) - halves
    doc = np.repeat(np.arange(len(halves)), halves)
    act = np.maximum(top, 0)
    d_act = np.zeros_like(act)
    ends = np.zeros(len(act), bool)
    ends[first + halves - 1] = True
    own = ends[:, None] | (act >= np.r_[act[1:], act[:1]])  # which half gives a chunk's maximum
    d_mean = (d_x[:, FILTERS : 2 * FILTERS] / halves[:, None])[doc]
    d_act += d_mean * own
    d_act[1:] += (d_mean * ~own)[:-1]
    best = act >= np.maximum.reduceat(act, first)[doc]
    best &= np.cumsum(best, 0) - (np.cumsum(best, 0)[first] - best[first])[doc] == 1  # the first of equals
    d_act += np.where(best, d_x[:, :FILTERS][doc], 0)
    d_top = np.where(top > 0, d_act, 0)
    # to the places of the maxima
    place = raw.argmax(1) * STRIDE + np.arange(len(top))[:, None] * HALF
    padded = np.r_[data, np.zeros(WIDTH, np.uint8)]
    d_filters = np.zeros_like(net.filters)
    f = np.broadcast_to(np.arange(FILTERS), place.shape)
    for j in range(WIDTH):
        cells = padded[place + j].astype(np.int64) * FILTERS + f
        d_filters[j] = np.bincount(cells.ravel(), d_top.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return [d_filters, d_top.sum(0), d_layer, miss.sum(keepdims=True)]


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id`` and ``_score`` (0 to 1) for every row. Null and empty texts are one
    chunk of nothing; repeated rows are scored alike; an empty table gives no
    rows; further columns are ignored."""
    view = documents_view(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size, out = [], 0, []
            for text in batch.column(1).cast(pa.binary()):
                texts.append(text.as_py())
                size += len(texts[-1]) + HALF
                if size >= BUDGET:
                    out.append(net.predict(texts))
                    texts, size = [], 0
            if texts:
                out.append(net.predict(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *out]), pa.float64())], names=["_id", "_score"])

    return view.mapInArrow(run, f"_id {view.schema['_id'].dataType.simpleString()}, _score double")


def fit_on(docs: DataFrame, labels: DataFrame, keep, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Network:
    """A network from the labels (column ``quality``) for which ``keep`` holds."""
    return fit(labelled_sample(docs, labels, "quality", keep, id_col, text_col, sample, SAMPLE_BYTES))
