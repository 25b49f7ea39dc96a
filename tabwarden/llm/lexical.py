"""Ranked lexical search, term at a time with a limited set of accumulators.

Statistics over all documents (how many there are, their terms, and the documents
that hold each asked term) come first, as sums. Then the documents are searched in
blocks: a task makes the postings of a block for the asked terms, and answers every
item on them term by term, the rarest first. A document gets an accumulator when one
of the item's terms reaches it, as long as what the terms left can add to a new one,
at most, reaches the k-th largest partial score. From then on no accumulator is made,
and those that exist are updated to the end, so their scores are exact.

A document left without accumulator scores less than ``k`` others of its block, so
the ``k`` best of every block hold the ``k`` best of all. They are cut twice on the
way to one list: within groups of blocks, and then for the item.

Items are asked in batches of bounded text, one after the other, so what goes to the
tasks does not grow with the table of items.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwarden.llm.common import staged

#: Bytes of item text that are asked at once, on average.
BATCH_BYTES = 4_000_000
#: Bytes of document text that make a block, and that are cut into terms at once.
BLOCK_BYTES = 24_000_000
PIECE = 4_000_000
#: Groups of blocks whose best are cut before they meet.
GROUPS = 64

#: Terms are runs of ASCII letters and digits, and of all that is not ASCII.
_TO_TERMS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    start = 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        while end < len(data) and _TO_TERMS[data[end]] != 0x20:
            end += 1
        yield data[start:end].translate(_TO_TERMS).split()
        start = end


def _counted(data: bytes, asked: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """The number of terms of a text, and how often it has each asked one."""
    n, found = 0, Counter()
    for terms in terms_of(data):
        n += len(terms)
        found.update(filter(asked.__contains__, terms))
    return n, {asked[t]: c for t, c in found.items()}


@dataclass(frozen=True)
class Statistics:
    """Documents that have terms, all their terms, and those holding each asked term."""

    documents: int
    terms: int
    holding: np.ndarray

    def weights(self) -> np.ndarray:
        top = 2 * self.documents + 2
        return np.array([math.floor(1000 * math.log(top / (2 * int(df) + 1))) for df in self.holding], np.int64)

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        return 100 - 50 + (50 * lengths * self.documents) // max(self.terms, 1)


@dataclass(frozen=True)
class Batch:
    """Items asked at once: their terms, named by place in ``vocabulary``."""

    items: list
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: Iterable[tuple[object, str]]) -> Batch:
        found: dict[object, set[bytes]] = {}
        for item, text in rows:
            held = found.setdefault(item, set())
            for terms in terms_of(text.encode()):
                held.update(terms)
        found = {item: held for item, held in found.items() if held}
        vocabulary = {t: k for k, t in enumerate(sorted(set().union(*found.values())))}
        return cls(list(found), [np.array(sorted(vocabulary[t] for t in held)) for held in found.values()], vocabulary)


def _texts(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, bytes]]:
    for batch in batches:
        for k, text in enumerate(batch.column(column)):
            yield batch, k, text.as_buffer().to_pybytes() if text.is_valid else b""


def statistics(docs: DataFrame, batch: Batch) -> Statistics:
    """Sums over all documents; of them only the counts of asked terms reach the driver."""
    size, asked = len(batch.vocabulary), batch.vocabulary

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, terms, holding = 0, 0, np.zeros(size, np.int64)
        for _, _, data in _texts(batches, 0):
            n, found = _counted(data, asked)
            documents, terms = documents + (n > 0), terms + n
            holding[list(found)] += 1
        at = np.flatnonzero(holding)
        keys = np.concatenate([[-2, -1], at])
        values = np.concatenate([[documents, terms], holding[at]])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.int64())], ["key", "value"])

    sums = docs.select("text").mapInArrow(run, "key long, value long").groupBy("key").agg(F.sum("value").alias("value"))
    known = {r.key: r.value for r in sums.collect()}
    return Statistics(known.get(-2, 0), known.get(-1, 0), np.array([known.get(k, 0) for k in range(size)], np.int64))


def best(postings: list[tuple[np.ndarray, np.ndarray]], bounds: list[int], order: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (in ``order``'s ranks) and scores of the ``k`` best of a block.

    ``postings`` are the documents and what each adds, of an item's terms from the
    rarest on; ``bounds`` the most that a term adds. ``order`` ranks the documents
    among equal scores.
    """
    scores = np.zeros(size, np.int64)
    held = np.zeros(size, bool)
    left = sum(bounds)
    creating = True
    for (docs, adds), bound in zip(postings, bounds, strict=True):
        if creating:
            now = scores[held]
            # A new accumulator could get `left` at most; equal scores can still win by order.
            if len(now) >= k and np.partition(now, len(now) - k)[len(now) - k] > left:
                creating = False
        if creating:
            held[docs] = True
            scores[docs] += adds
        else:
            survives = held[docs]
            scores[docs[survives]] += adds[survives]
        left -= bound
    found = np.flatnonzero(held & (scores > 0))
    if len(found) > k:
        least = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= least]
    found = found[np.lexsort((order[found], -scores[found]))][:k]
    return found, scores[found]


def _searched(docs: DataFrame, batch: Batch, stats: Statistics, k: int) -> DataFrame:
    """``item, doc_id, score`` of the ``k`` best of every block for each item."""
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    weights, vocabulary = stats.weights(), batch.vocabulary
    rarest = [t[np.lexsort((t, -weights[t]))] for t in batch.terms]

    def answered(ids: pa.Array, lengths: list[int], found: tuple[array, array, array]) -> pa.RecordBatch:
        size = len(lengths)
        norms = stats.norms(np.array(lengths, np.int64))
        # Equal scores go to the smaller id, null ids last; of equal ids the first row.
        order = np.empty(size, np.int64)
        order[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(size)
        term, docs_, tf = (np.frombuffer(x, np.int64) if len(x) else np.empty(0, np.int64) for x in found)
        by_term = np.argsort(term, kind="stable")
        term, docs_, tf = term[by_term], docs_[by_term], tf[by_term]
        edges = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        adds = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norms[docs_]))
        items, at, scores = [], [], []
        for item, terms in enumerate(rarest):
            postings = [(docs_[edges[t] : edges[t + 1]], adds[edges[t] : edges[t + 1]]) for t in terms]
            postings = [p for p in postings if len(p[0])]
            if not postings:
                continue
            places, points = best(postings, [int(p[1].max()) for p in postings], order, size, k)
            items.append(np.full(len(places), item)), at.append(places), scores.append(points)
        joined = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(joined(items), pa.int32()), ids.take(pa.array(joined(at), pa.int64())), pa.array(joined(scores), pa.int64())],
            ["item", "doc_id", "score"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = lambda: (array("q"), array("q"), array("q"))
        ids, lengths, found, held = [], [], nothing(), 0
        for batch_, row, data in _texts(batches, 1):
            n, counts = _counted(data, vocabulary)
            if n:
                ids.append(batch_.column(0).slice(row, 1))
                found[0].extend(counts)
                found[1].extend([len(lengths)] * len(counts))
                found[2].extend(counts.values())
                lengths.append(n)
            held += len(data)
            if held >= BLOCK_BYTES and lengths:
                yield answered(pa.concat_arrays(ids), lengths, found)
                ids, lengths, found, held = [], [], nothing(), 0
        if lengths:
            yield answered(pa.concat_arrays(ids), lengths, found)

    return docs.select("doc_id", "text").mapInArrow(run, f"item int, doc_id {id_kind}, score long")


def _cut(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents.

    Scores above 0 only; fewer rows if fewer documents have one. Equal scores go to
    the smaller ``doc_id``, a null one last. Null and empty texts have no terms: such
    documents count for nothing, such items give no row. Rows of the same ``item_id``
    (null included) are one item of all their terms; rows of the same ``doc_id`` are
    documents of their own. Other columns are ignored.
    """
    item_kind = items.schema["item_id"].dataType.simpleString()
    asked = staged(items.select("item_id", "text").filter(F.octet_length("text") > 0).distinct(), "asked")
    size = asked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    batches = max(1, math.ceil(size / BATCH_BYTES))
    part = F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(batches))
    results: list[DataFrame] = []
    for number in range(batches):
        rows = asked.filter(part == number).collect()  # about BATCH_BYTES of text
        batch = Batch.of((r.item_id, r.text) for r in rows)
        if not batch.items:
            continue
        found = _searched(docs, batch, statistics(docs, batch), k)
        found = found.withColumn("block_group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
        top = _cut(_cut(found, ["item", "block_group"], k).drop("rank"), ["item"], k)
        names = docs.sparkSession.createDataFrame(list(enumerate(batch.items)), f"item int, item_id {item_kind}")
        results.append(staged(top.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score"), "ranked"))
    if not results:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
