"""Deletion of repeated passages: seed on winnowed anchors, extend, keep long repeats.

Every document is hashed word by word. An anchor is a run of ``ANCHOR`` words; of the
anchors of any ``LEAST`` consecutive words the one with the least hash is kept, the
same one wherever these words stand. So two documents that share ``LEAST`` words
share an anchor at the same place of them.

Anchors that more than one document has are the seeds. Every seed is extended both
ways, within the windows of ``LEAST`` words of which it is the least anchor, and meets
the first place of its anchor, in the order of ``doc_id``. Where the extended words
agree they are a repeat of ``LEAST`` words or more, kept if the first place is of a
smaller ``doc_id``: its words go. Repeats of neighbouring seeds overlap, so together
they are the maximal repeats.

What a seed does not share with the first place it may still share with another
document. Places that have such a window in common differ from the first place alike,
so these windows meet among themselves, by digest, each with its least ``doc_id``. Thus
every place meets two others at most, never all copies, and what is found is the same
as by comparing all.

Windows are compared by two hashes of 64 bits, of the anchor and of all their words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.common import forget, fresh, packed, spread, staged

#: Words of a repeat, and of an anchor.
LEAST = 13
ANCHOR = 7
#: Words to either side of an anchor that a window around it can have.
REACH = LEAST - ANCHOR
#: Bytes of the digests of a seed.
WIDTH = 8 * (REACH + 1)
#: Bytes of text whose rows are made at once.
PIECE = 2_000_000

#: Bytes of a word that are hashed with those of all others; longer words go one by one.
SHORT = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX, _CHECK = np.uint64(0xC6A4A7935BD1E995), np.uint64(0xFF51AFD7ED558CCD)


def word_edges(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words ``[^\\x20\\x09-\\x0D]+`` of a text start and end, in bytes."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[np.frombuffer(data, np.uint8)]
    turns = np.flatnonzero(space[1:] != space[:-1])
    return turns[::2], turns[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a text, none of them 0."""
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))  # from every byte on
    lengths = ends - starts
    h = lengths.astype(np.uint64) * _STEP
    at = np.arange(len(starts))
    for k in range(0, SHORT, 8):
        h[at] = spread((h[at] ^ (eight[starts[at] + k] & _MASK[np.minimum(lengths[at] - k, 8)])) * _MIX)
        at = at[lengths[at] > k + 8]
        if not len(at):
            break
    for k in at:  # longer words
        h[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return np.maximum(h, np.uint64(1))


def _runs(words: np.ndarray, factor: np.uint64, length: int) -> np.ndarray:
    """A hash of every run of so many words, none of them 0."""
    n = max(0, len(words) - length + 1)
    h = words[:n].copy()
    for k in range(1, length):
        h *= factor
        h += words[k : k + n]
    return np.maximum(spread(h), np.uint64(1))


def _over(values: np.ndarray, choose: np.ufunc) -> np.ndarray:
    """Least or largest of every ``REACH + 1`` values, by halves."""
    span = 1
    while 2 * span <= REACH + 1:
        values, span = choose(values[:-span], values[span:]), 2 * span
    rest = REACH + 1 - span
    return choose(values[:-rest], values[rest:]) if rest else values


class Words:
    """The words of some texts, hashed together.

    ``first[k]`` is the number of the first word of text k (and the end of those
    before). ``grams`` are the hashes of runs of ``ANCHOR`` words; ``least`` is the
    least of those in the window of ``LEAST`` words that starts at a word, 0 if the
    window leaves its text.
    """

    def __init__(self, texts: list[bytes]):
        data = b"\n".join(texts)
        starts, ends = word_edges(data)
        self.hashes = word_hashes(data, starts, ends)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(starts, begins)
        n = len(starts)
        self.grams = _runs(self.hashes, _MIX, ANCHOR)
        if n < LEAST:
            self.least = np.empty(0, np.uint64)
            return
        text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.least = _over(self.grams, np.minimum)
        self.least[text[: n - LEAST + 1] != text[LEAST - 1 :]] = 0

    def digests(self) -> np.ndarray:
        """A hash of each window of ``LEAST`` words, unlike those of the anchors."""
        return _runs(self.hashes, _CHECK, LEAST)

    def anchors(self) -> np.ndarray:
        """The numbers of the words where an anchor starts: a run that is the least
        of some window (each one, of equal runs)."""
        if not len(self.least):
            return np.empty(0, np.int64)
        around = np.concatenate([np.zeros(REACH, np.uint64), self.least, np.zeros(REACH, np.uint64)])
        return np.flatnonzero(_over(around, np.maximum) == self.grams)

    def windows(self, places: np.ndarray) -> np.ndarray:
        """Whether an anchor is the least of the windows that start 0, 1, .. words
        before it, for each anchor."""
        starts = places[:, None] - np.arange(REACH + 1)
        inside = (starts >= 0) & (starts < len(self.least))
        return inside & (self.least[np.clip(starts, 0, len(self.least) - 1)] == self.grams[places][:, None])


def _as_long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[range, list[bytes]]]:
    texts = batch.column(column)
    sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
    for group in packed(sizes, PIECE):
        yield group, [texts[k].as_buffer().to_pybytes() if sizes[k] else b"" for k in group]


def _anchored(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, anchor, place`` of all winnowed anchors of ``doc_id, mark, text``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, texts in _texts(batch, 2):
                words = Words(texts)
                at = words.anchors()
                text = np.searchsorted(words.first, at, "right") - 1
                take = pa.array(text + group.start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), _as_long(words.grams[at]), pa.array((at - words.first[text]).astype(np.int32))],
                    ["doc_id", "mark", "anchor", "place"],
                )

    return docs.select("doc_id", "mark", "text").mapInArrow(run, f"doc_id {kind}, mark long, anchor long, place int")


def _extensions(docs: DataFrame) -> DataFrame:
    """The seeds of ``doc_id, mark, text, seeds`` rows, extended both ways.

    ``around`` holds a digest for each way to extend the anchor to ``LEAST`` words: by
    0, 1, .. words to the left and the rest to the right. It is 0 where these words
    leave the text, and where another anchor is the least of their window, which then
    stands for them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, texts in _texts(batch, 2):
                words = Words(texts)
                asked = batch.column(3).slice(group.start, len(group))
                text = np.repeat(np.arange(len(group)), asked.value_lengths().to_numpy())
                seeds = asked.flatten()
                place = seeds.field("place").to_numpy().astype(np.int64)
                at = place + words.first[text]
                whole = words.digests()
                starts = np.clip(at[:, None] - np.arange(REACH + 1), 0, len(whole) - 1)
                flat = np.ascontiguousarray(np.where(words.windows(at), whole[starts], np.uint64(0)), dtype="<u8")
                take = pa.array(text + group.start)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        _as_long(words.grams[at]),
                        pa.array(place.astype(np.int32)),
                        seeds.field("least"),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(flat), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary()),
                    ],
                    ["doc_id", "mark", "anchor", "place", "least", "around"],
                )

    schema = f"doc_id {kind}, mark long, anchor long, place int, least {kind}, around binary"
    return docs.select("doc_id", "mark", "text", "seeds").mapInArrow(run, schema)


def _matched(met: DataFrame, kind: str) -> DataFrame:
    """Repeats ``doc_id, mark, start, stop`` of seeds and the first place of their
    anchors, and the windows left over: rows with ``anchor, digest`` and no ``stop``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            rows = lambda name: np.frombuffer(b"".join(column[name].to_pylist()), "<u8").reshape(batch.num_rows, REACH + 1)  # noqa: B023, E731
            mine = rows("around")
            same = (mine == rows("around0")) & (mine != 0)
            at = column["place"].to_numpy().astype(np.int64)
            later = column["later"].to_numpy(zero_copy_only=False)
            # Windows that agree overlap, so they are one repeat, from the farthest on the left on.
            long = np.flatnonzero(later & same.any(axis=1))
            fewest, most = same[long].argmax(axis=1), REACH - same[long][:, ::-1].argmax(axis=1)
            open_, j = np.nonzero((mine != 0) & ~same)
            take = pa.array(np.concatenate([long, open_]))
            starts = np.concatenate([at[long] - most, at[open_] - j])
            stops = np.concatenate([at[long] - fewest + LEAST, np.full(len(open_), -1)])
            digest = np.concatenate([np.zeros(len(long), np.uint64), mine[open_, j]])
            yield pa.RecordBatch.from_arrays(
                [
                    column["doc_id"].take(take),
                    column["mark"].take(take),
                    pa.array(starts.astype(np.int32)),
                    pa.array(stops.astype(np.int32), mask=stops < 0),
                    column["anchor"].take(take),
                    _as_long(digest),
                ],
                ["doc_id", "mark", "start", "stop", "anchor", "digest"],
            )

    return met.mapInArrow(run, f"doc_id {kind}, mark long, start int, stop int, anchor long, digest long")


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, start, stop``: runs of words (numbers from 0, ``stop`` not
    included) of ``LEAST`` words or more that a document with a smaller ``doc_id`` has.

    They overlap; their union is the union of all windows of ``LEAST`` words that
    start in a document with a smaller ``doc_id``. ``mark`` is the hash of the text.
    Null and empty texts have no words. Rows of one ``doc_id`` never repeat each
    other, and rows of a null one neither repeat nor are repeated. Other columns are
    ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    # Counted before the shuffle, so a common anchor is a row of each task.
    found = _anchored(texts)
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = staged(shared.filter("least < most").select("anchor", "least"), "seeds", tidy=True)
    # At most as many seeds as the document has words.
    seeds = found.join(shared, "anchor").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("place", "least")).alias("seeds"))
    seeds = staged(seeds, "document-seeds", tidy=True)
    asked = texts.join(seeds, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    extended = staged(_extensions(asked), "extensions", tidy=True)
    forget(seeds)

    # Written, so that the join has plain tables on both sides and splits hot anchors.
    first = extended.filter(F.col("doc_id") == F.col("least")).groupBy("anchor").agg(F.min_by("around", F.struct("mark", "place")).alias("around0"))
    first = staged(first, "first-places", tidy=True)
    met = extended.join(first, "anchor").select("doc_id", "mark", "anchor", "place", "around", "around0", (F.col("least") < F.col("doc_id")).alias("later"))
    matched = staged(_matched(met, kind), "matched", tidy=True)
    forget(extended), forget(first)
    windows = matched.filter("stop is null").select("doc_id", "mark", "start", "anchor", "digest")
    least = windows.groupBy("anchor", "digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    least = staged(least.drop("most"), "shared-windows", tidy=True)
    more = windows.join(least, ["anchor", "digest"]).filter(F.col("doc_id") > F.col("least"))
    more = more.select("doc_id", "mark", "start", (F.col("start") + LEAST).alias("stop"))
    repeated = staged(matched.filter("stop is not null").select("doc_id", "mark", "start", "stop").union(more), "repeats", tidy=True)
    forget(matched), forget(least)
    return repeated


def _kept(words: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of so many words no repeat covers."""
    depth = np.zeros(words + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, stops, -1)
    return np.cumsum(depth)[:words] == 0


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents, all columns, with the words that ``repeats`` names deleted and
    the words left joined by single spaces; texts without a repeat are untouched.
    Adds ``n_words``, ``n_removed`` and ``kept_sha256`` (of the words left, joined by
    single spaces; of the empty text for null)."""
    names = {n: fresh(docs, n) for n in ("n_words", "n_removed", "kept_sha256")}
    spans, id_, mark = fresh(docs, "spans"), fresh(docs, "span_id"), fresh(docs, "span_mark")
    by_doc = found.groupBy(F.col("doc_id").alias(id_), F.col("mark").alias(mark)).agg(F.collect_list(F.struct("start", "stop")).alias(spans))
    marked = docs.join(by_doc, (docs["doc_id"] == by_doc[id_]) & (F.xxhash64(docs["text"]) == by_doc[mark]), "left").select(*[docs[c] for c in docs.columns], spans)
    text_at, spans_at = docs.columns.index("text"), len(docs.columns)
    out_names = [*docs.columns, *names.values()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, texts in _texts(batch, text_at):
                new, total, removed, digests = [], [], [], []
                for k, text in zip(group, texts, strict=True):
                    words = text.split()  # ASCII white space is what parts words
                    cut = batch.column(spans_at)[k].as_py()
                    left = words
                    if cut:
                        edges = np.array([(x["start"], x["stop"]) for x in cut], np.int64)
                        left = [words[i] for i in np.flatnonzero(_kept(len(words), edges[:, 0], edges[:, 1]))]
                    said = b" ".join(left)
                    total.append(len(words)), removed.append(len(words) - len(left)), digests.append(sha256(said).hexdigest())
                    new.append(said.decode() if cut else batch.column(text_at)[k].as_py())
                part = batch.slice(group.start, len(group))
                columns = [pa.array(new, part.schema.field(j).type) if j == text_at else part.column(j) for j in range(spans_at)]
                counts = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *counts], out_names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{names['n_words']} long, {names['n_removed']} long, {names['kept_sha256']} string"])
    return marked.mapInArrow(run, schema)
