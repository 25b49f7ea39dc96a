"""Toxicity: averaged subword-bag embeddings under a linear softmax.

A word is the bag of its character n-grams (between word marks) and of itself,
hashed into a fixed number of buckets. Every bucket has an embedding; a window of
``WINDOW`` words is the mean of its words, each the mean of its subwords, and a
softmax layer over that mean gives the window's log-odds. A document is as toxic
as its worst window, so a few words in a long text are not averaged away. Embeddings
and softmax are trained jointly, in numpy, from whole texts of a bounded sample; in
training the windows are pooled by a soft maximum that sharpens as it goes.

Misspellings that were never seen share most n-grams with words that were, and so
share their vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.common import labelled_sample, packed, slices

#: Lengths of the n-grams, word marks included.
GRAMS = (3, 4, 5, 6)
#: Embeddings are kept in 2 ** BITS buckets.
BITS = 18
WIDTH = 8
#: Words in a window.
WINDOW = 2
#: The pooling of windows in each epoch of training, from nearly a mean to nearly a
#: maximum; the last one holds for the rest.
SHARPNESS = (0.25, 0.5, 0.75, 1.0, 2.0, 4.0)
#: Bounds of the sample that the model is fitted on.
SAMPLE_ROWS = 4_000
SAMPLE_BYTES = 14_000_000
#: Texts are scored in pieces of at most so many characters, cut at white space.
PIECE = 200_000

_MULTIPLY = np.uint32(0x9E3779B1)
_STEP = np.uint32(0x01000193)


def _word_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.arange(ord("a"), ord("z") + 1)] = True
    table[np.arange(ord("0"), ord("9") + 1)] = True
    table[128:] = True
    return table


_IS_WORD = _word_bytes()


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * _MULTIPLY
    return h >> np.uint32(32 - BITS)


@dataclass
class Words:
    """The words of a buffer, and where their subwords' buckets are found."""

    starts: np.ndarray
    lengths: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]  # positions (first byte + 1), buckets
    whole: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        """Subwords of each word."""
        total = np.ones(len(self.lengths), np.int64)
        for n in GRAMS:
            total += np.maximum(self.lengths + 3 - n, 0)
        return total


def words_of(buffer: bytes) -> Words:
    """Find the words of a lower-case UTF-8 buffer and hash their subwords."""
    raw = np.frombuffer(b" " + buffer + b" " * max(GRAMS), np.uint8)
    inside = _IS_WORD[raw]
    codes = np.where(inside, raw, np.uint8(32)).astype(np.uint32)
    edge = np.diff(inside.astype(np.int8))
    starts = np.flatnonzero(edge == 1) + 1
    lengths = np.flatnonzero(edge == -1) + 1 - starts
    found = []
    n = len(raw)
    h = codes[: n - 1] * _STEP + codes[1:]
    good = inside[1:]  # inner bytes of the gram that starts one before
    for width in range(3, max(GRAMS) + 1):
        h = h[: n - width + 1] * _STEP + codes[width - 1 :]
        if width > 3:
            good = good[: n - width + 1] & inside[width - 2 : n - 1]
        else:
            good = good[: n - width + 1]
        if width in GRAMS:
            at = np.flatnonzero(good)
            found.append((at + 1, _bucket(h[at] + np.uint32(width * 0x3779B1))))
    # A word's own hash: a sum of its bytes, each weighted by its place.
    power = np.cumprod(np.full(64, _STEP, np.uint32), dtype=np.uint32)
    inner = np.flatnonzero(inside)
    rank = np.arange(len(inner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    weighted = codes[inner] * power[rank & 63] + rank.astype(np.uint32)
    whole = (
        np.add.reduceat(weighted.astype(np.uint32), np.cumsum(lengths) - lengths, dtype=np.uint32)
        if len(lengths)
        else np.empty(0, np.uint32)
    )
    return Words(starts, lengths, found, _bucket(whole))


def _word_odds(words: Words, weight: np.ndarray, size: int) -> np.ndarray:
    """Log-odds of each word: the mean of its subwords' weights."""
    if not len(words.starts):
        return np.empty(0)
    at = np.zeros(size + 16)
    for places, buckets in words.grams:
        # Grams of one length have places of their own.
        at[places] += weight[buckets]
    totals = np.add.reduceat(at, words.starts)
    return (totals + weight[words.whole]) / words.counts


def _windows(odds: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of all windows and the document of each; a text with fewer words than
    a window is one window."""
    sums = np.concatenate([[0.0], np.cumsum(odds)])
    doc = np.repeat(np.arange(len(first)), last - first)
    begin = np.arange(len(odds))
    end = begin + WINDOW
    short = (last - first)[doc] < WINDOW
    end = np.where(short, last[doc], end)
    keep = (end <= last[doc]) & (~short | (begin == first[doc]))
    begin, end, doc = begin[keep], end[keep], doc[keep]
    return (sums[end] - sums[begin]) / (end - begin), doc


@dataclass
class ToxicityModel:
    """Per bucket the log-odds of its embedding, and the softmax's bias."""

    weight: np.ndarray
    bias: float

    def odds(self, texts: list[str]) -> np.ndarray:
        """Log-odds of each text. A text without words gets the bias."""
        pieces = [(i, p.lower().encode("utf-8", "replace")) for i, t in enumerate(texts) for p in slices(t, PIECE)]
        top = np.full(len(texts), -np.inf)
        for group in packed([len(p) for _, p in pieces], 2 * PIECE):
            owners = np.array([pieces[k][0] for k in group])
            buffers = [pieces[k][1] for k in group]
            sizes = np.array([len(b) + 1 for b in buffers])
            joined = b" ".join(buffers)
            words = words_of(joined)
            ends = np.cumsum(sizes)
            of = np.searchsorted(ends, words.starts - 1, side="right")
            count = np.bincount(of, minlength=len(buffers))
            last = np.cumsum(count)
            values, doc = _windows(_word_odds(words, self.weight, len(joined) + 16), last - count, last)
            if not len(values):
                continue
            np.maximum.at(top, owners[doc], values)
        return np.where(np.isfinite(top), top, 0.0) + self.bias

    def score(self, texts: list[str]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.odds(texts), -60, 60)))


def train(sample: list[tuple[str, int]], epochs: int = 12, batch: int = 256, rate: float = 0.05, seed: int = 7) -> ToxicityModel:
    """Fit embeddings and softmax jointly with Adam. An empty sample gives a model
    that scores every text one half."""
    rng = np.random.default_rng(seed)
    buckets = 1 << BITS
    if not sample:
        return ToxicityModel(np.zeros(buckets), 0.0)
    vocabulary: dict[str, int] = {}
    texts = []
    for text, _ in sample:
        low = bytes(np.where(_IS_WORD[(b := np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8))], b, np.uint8(32)))
        texts.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in low.split()], np.int32))
    label = np.array([y for _, y in sample], float)
    words = words_of(b" ".join(vocabulary))
    del vocabulary  # this runs on the driver: what is done with goes
    counts = words.counts.astype(float)
    rows, cols = [np.arange(len(counts), dtype=np.int32)], [words.whole]
    for places, found in words.grams:
        rows.append(np.searchsorted(words.starts, places, side="right").astype(np.int32) - 1)
        cols.append(found)
    del words
    row, col = np.concatenate(rows), np.concatenate(cols)
    del rows, cols
    order = np.argsort(row, kind="stable")
    row, col = row[order], col[order]
    del order
    begin = np.searchsorted(row, np.arange(len(counts)))
    size = np.diff(np.append(begin, len(row)))

    del row
    used = np.unique(col)
    col = np.searchsorted(used, col).astype(np.int32)
    embed = rng.uniform(-1 / WIDTH, 1 / WIDTH, (len(used), WIDTH))
    soft = rng.uniform(-1 / WIDTH, 1 / WIDTH, (WIDTH, 2))
    bias = np.zeros(2)
    params = [embed, soft, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(epochs):
        sharp = SHARPNESS[min(epoch, len(SHARPNESS) - 1)]
        shuffled = rng.permutation(len(texts))
        for at in range(0, len(texts), batch):
            ids = shuffled[at : at + batch]
            docs = [texts[i] for i in ids if len(texts[i])]
            y = np.array([label[i] for i in ids if len(texts[i])])
            if not docs:
                continue
            flat = np.concatenate(docs)
            vocab, flat = np.unique(flat, return_inverse=True)
            n = size[vocab]
            take = np.repeat(begin[vocab] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            sub = col[take]
            owner = np.repeat(np.arange(len(vocab)), n)
            edge = np.cumsum(n) - n
            diff = soft[:, 1] - soft[:, 0]
            weight = embed @ diff
            odds = np.add.reduceat(weight[sub], edge) / counts[vocab]
            last = np.cumsum([len(d) for d in docs])
            first = last - np.array([len(d) for d in docs])
            values, doc = _windows(odds[flat], first, last)
            values = values * sharp
            cut = np.flatnonzero(np.diff(doc, prepend=-1))
            best = np.maximum.reduceat(values, cut)
            share = np.exp(values - best[doc])
            mass = np.add.reduceat(share, cut)
            share /= mass[doc]
            # Early, the pooled value is made comparable to a mean.
            z = (best + np.log(mass) - (np.log(np.bincount(doc)) if sharp < 1 else 0.0)) / sharp + bias[1] - bias[0]
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            g = (p - y) / len(docs)
            gw = share * g[doc]  # per window
            # Back to words: each word of a window gets an equal part.
            per = np.zeros(len(flat) + 1)
            begin_w = _window_starts(first, last)
            width = np.minimum(WINDOW, (last - first))[doc]
            np.add.at(per, begin_w, gw / width)
            np.add.at(per, begin_w + width, -gw / width)
            gword = np.bincount(flat, weights=np.cumsum(per)[:-1], minlength=len(vocab)) / counts[vocab]
            gs = np.bincount(sub, weights=gword[owner], minlength=len(used))
            active = np.flatnonzero(gs)
            gdiff = embed[active].T @ gs[active]
            grads = [(active, gs[active, None] * diff[None, :]), (slice(None), np.stack([-gdiff, gdiff], 1)), (slice(None), np.array([-g.sum(), g.sum()]))]
            step += 1
            for (m, v), param, (where, grad) in zip(moments, params, grads, strict=True):
                m[where] = 0.9 * m[where] + 0.1 * grad
                v[where] = 0.99 * v[where] + 0.01 * grad * grad
                param[where] -= rate * (m[where] / (1 - 0.9**step)) / (np.sqrt(v[where] / (1 - 0.99**step)) + 1e-8)
    weight = np.zeros(buckets)
    weight[used] = embed @ (soft[:, 1] - soft[:, 0])
    return ToxicityModel(weight, float(bias[1] - bias[0]))


def _window_starts(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first word of each window, in the order of ``_windows``."""
    doc = np.repeat(np.arange(len(first)), last - first)
    begin = np.arange(len(doc))
    short = (last - first)[doc] < WINDOW
    keep = np.where(short, begin == first[doc], begin + WINDOW <= last[doc])
    return begin[keep]


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "toxic", rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """Fit on at most ``rows`` labelled texts of at most ``text_bytes`` bytes in all."""
    return train(labelled_sample(docs, labels, label, learn_from, rows, text_bytes))


def scorer(model: ToxicityModel, docs: DataFrame):
    """A function of a text column that gives its score, 0 to 1. Null is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(text: pd.Series) -> pd.Series:
        texts = text.fillna("").tolist()
        groups = packed([len(t) for t in texts], 4 * PIECE)
        return pd.Series(np.concatenate([np.empty(0), *(shared.value.score(texts[g.start : g.stop]) for g in groups)]))

    return toxicity


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Score every whole text: ``doc_id, score, predicted``.

    Other columns are ignored, whatever their names. Null and empty texts, and
    texts without words, get the score of the bias. Repeated rows are scored alike
    and all returned; an empty table gives an empty result.
    """
    score = scorer(model, docs)
    return docs.select("doc_id", score(F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
