"""Quality: a byte-level convolutional network, in numpy.

Filters of ``SPAN`` bytes slide over the whole document. The document is cut into
overlapping chunks; each filter's rectified response is max-pooled over a chunk,
and the chunks' pooled vectors are combined, by their mean and their maximum, into
one probability. The overlap is ``SPAN - 1`` bytes and more, so every span of bytes
lies whole in some chunk. Filters act on bytes directly (one weight for each place,
byte and filter), trained with the output layer by gradient descent on whole texts
of a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.common import labelled_sample, packed

#: Bytes that a filter sees, an even number: filters are applied by pairs of bytes.
SPAN = 6
FILTERS = 16
CHUNK = 1024
OVERLAP = 64
#: Bounds of the sample that the model is fitted on.
SAMPLE_ROWS = 5_000
SAMPLE_BYTES = 20_000_000
#: Bytes that are convolved at once.
BLOCK = 100_000


def chunk_starts(size: int) -> np.ndarray:
    """Starts of the chunks of a text; an empty text has one chunk of nothing."""
    return np.arange(0, max(1, size - OVERLAP), CHUNK - OVERLAP)


def fill(sizes: np.ndarray) -> np.ndarray:
    """How full the first chunk is, on a scale of logarithms: short texts have low
    maxima because they are short, not because they say little."""
    return np.log1p(np.minimum(sizes, CHUNK)) / np.log1p(CHUNK) - 1


def _pair_tables(filters: np.ndarray) -> np.ndarray:
    """Responses to each pair of bytes, for each pair of places."""
    return (filters[0::2, :, None, :] + filters[1::2, None, :, :]).reshape(SPAN // 2, 65536, FILTERS)


def _responses(tables: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Responses at each byte but the last SPAN - 1."""
    pairs = raw[:-1].astype(np.int32) * 256 + raw[1:]
    n = len(raw) - SPAN + 1
    out = np.take(tables[0], pairs[:n], axis=0)
    for k in range(1, SPAN // 2):
        out += np.take(tables[k], pairs[2 * k : 2 * k + n], axis=0)
    return out


@dataclass
class QualityModel:
    filters: np.ndarray  # SPAN, 256, FILTERS
    shift: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS + 1: weights of the mean, of the maximum and of the fill
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        tables = _pair_tables(self.filters).astype(np.float32)
        shift = self.shift.astype(np.float32)
        sizes = np.zeros(len(texts))
        total, top, chunks = np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS)), np.zeros(len(texts))
        # Pieces of whole chunks, so that a long text never lies in memory as responses.
        # Spans at the end of a piece see the bytes that follow it in the text.
        pieces: list[tuple[int, bytes, bytes]] = []
        for i, text in enumerate(texts):
            raw = text.encode("utf-8", "replace")
            sizes[i] = len(raw)
            starts = chunk_starts(len(raw))
            step = max(1, BLOCK // (CHUNK - OVERLAP))
            for k in range(0, len(starts), step):
                end = starts[min(k + step, len(starts)) - 1] + CHUNK
                pieces.append((i, raw[starts[k] : end], raw[end : end + SPAN].ljust(SPAN, b"\0")))
        for group in packed([len(p) for _, p, _ in pieces], BLOCK):
            buffer, begins, ends, owners = [], [], [], []
            at = 0
            for k in group:
                owner, piece, beyond = pieces[k]
                for s in chunk_starts(len(piece)):
                    begins.append(at + s)
                    ends.append(at + max(1, min(s + CHUNK, len(piece))))
                    owners.append(owner)
                buffer.append(piece + beyond)
                at += len(piece) + SPAN
            raw = np.frombuffer(b"".join(buffer) + b"\0" * SPAN, np.uint8)
            found = _responses(tables, raw)
            edges = np.stack([begins, ends], 1).ravel()
            pooled = np.maximum(np.maximum.reduceat(found, edges, axis=0)[::2] + shift, 0)
            np.add.at(total, owners, pooled)
            np.maximum.at(top, owners, pooled)
            np.add.at(chunks, owners, 1)
        z = np.concatenate([total / np.maximum(chunks, 1)[:, None], top, fill(sizes)[:, None]], 1) @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(sample: list[tuple[str, int]], epochs: int = 8, batch: int = 48, rate: float = 0.01, seed: int = 11) -> QualityModel:
    """Fit filters and output layer by Adam. An empty sample gives a model that
    scores every text one half."""
    rng = np.random.default_rng(seed)
    filters = rng.normal(0, 0.3, (SPAN, 256, FILTERS))
    shift, out, bias = np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS + 1), np.zeros(1)
    if not sample:
        return QualityModel(filters, shift, np.zeros(2 * FILTERS + 1), 0.0)
    raws = [t.encode("utf-8", "replace") for t, _ in sample]
    label = np.array([y for _, y in sample], float)
    filled = fill(np.array([len(r) for r in raws]))
    # Both labels weigh alike half-way, so that the rarer one is learnt early.
    rare = np.clip(label.mean(), 0.02, 0.98)
    weigh = np.where(label > 0, (0.5 / rare) ** 0.5, (0.5 / (1 - rare)) ** 0.5)
    params = [filters, shift, out, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(raws))
        speed = rate * (1 - epoch / epochs) ** 0.5
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            tables = _pair_tables(filters).astype(np.float32)
            chunks, owner = [], []
            for k, i in enumerate(ids):
                for s in chunk_starts(len(raws[i])):
                    chunks.append(raws[i][s : s + CHUNK])
                    owner.append(k)
            owner = np.array(owner)
            lengths = np.array([max(1, len(c)) for c in chunks])
            raw = np.frombuffer(b"".join(c + b"\0" * SPAN if c else b"\0" * (SPAN + 1) for c in chunks) + b"\0" * SPAN, np.uint8)
            begins = np.cumsum(lengths + SPAN) - (lengths + SPAN)
            found = _responses(tables, raw)
            places = np.stack([found[b : b + n].argmax(0) + b for b, n in zip(begins, lengths, strict=True)])
            value = found[places, np.arange(FILTERS)] + shift
            pooled = np.maximum(value, 0)
            n = np.bincount(owner, minlength=len(ids))
            mean = np.zeros((len(ids), FILTERS))
            np.add.at(mean, owner, pooled)
            mean /= n[:, None]
            edges = np.flatnonzero(np.diff(owner, prepend=-1))
            top = np.maximum.reduceat(pooled, edges, axis=0)
            features = np.concatenate([mean, top, filled[ids][:, None]], 1)
            z = features @ out + bias[0]
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            g = (p - label[ids]) * weigh[ids] / len(ids)
            gf = g[:, None] * out[None, :]
            gp = gf[owner, :FILTERS] / n[owner][:, None] + gf[owner, FILTERS : 2 * FILTERS] * (pooled == top[owner])
            gp *= value > 0
            gfilters = np.zeros_like(filters)
            col = np.broadcast_to(np.arange(FILTERS), places.shape)
            for j in range(SPAN):
                np.add.at(gfilters[j], (raw[places + j], col), gp)
            step += 1
            grads = [gfilters + 1e-6 * filters, gp.sum(0), features.T @ g + 1e-4 * out, np.array([g.sum()])]
            for (m, v), param, grad in zip(moments, params, grads, strict=True):
                m *= 0.9
                m += 0.1 * grad
                v *= 0.99
                v += 0.01 * grad * grad
                param -= speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return QualityModel(filters, shift, out, float(bias[0]))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "quality", rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Fit on at most ``rows`` labelled texts of at most ``text_bytes`` bytes in all."""
    return train(labelled_sample(docs, labels, label, learn_from, rows, text_bytes))


def scorer(model: QualityModel, docs: DataFrame):
    """A function of a text column that gives its score, 0 to 1. Null is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(text: pd.Series) -> pd.Series:
        texts = text.fillna("").tolist()
        groups = packed([len(t) for t in texts], 4 * BLOCK)
        return pd.Series(np.concatenate([np.empty(0), *(shared.value.score(texts[g.start : g.stop]) for g in groups)]))

    return quality


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Score every whole text: ``doc_id, score, predicted``.

    Other columns are ignored, whatever their names. Null and empty texts are
    scored as a chunk of nothing. Repeated rows are scored alike and all returned;
    an empty table gives an empty result.
    """
    score = scorer(model, docs)
    return docs.select("doc_id", score(F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
