"""BPE: a streaming transducer with bounded lookahead, and its decoder.

Merges apply in the order of the list, so what follows can change a token only
through a chain of merges that each cross the last boundary both readings agree on.
``lookahead`` computes from the list how far back such a chain can reach. A token
whose start lies further than that from the end of what was read is stable: the
transducer emits it and forgets its bytes. Its memory is one window, whatever the
length of the text. (Berglund and van der Merwe, "Formalizing BPE Tokenization",
2023, show that such a bound exists for every merge list.)

The decoder turns ids into text byte by byte with a state machine for UTF-8: it
holds at most three bytes, and replaces ill-formed sequences as lossy UTF-8
decoding does.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame


#: The pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text that are split at once, and bytes fed to the transducer at once.
PIECE = 65_536
FEED = 4_096
#: Words whose ids are remembered, per worker and generation; longer ones never are.
REMEMBERED = 300_000
REMEMBERED_BYTES = 64
#: Ids that are written out at once.
RUN = 16_384
#: In text without these characters, COMMON_SPLIT splits as PATTERN does, and faster.
UNCOMMON = re.compile("[^\\t-\\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
COMMON_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
SAFE_CUT = regex.compile(r"(?<=\S) (?=\S)")
#: Stands for "no merge".
NEVER = 1 << 62


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies:
    itself where it is printable Latin, else the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    free = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(free)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's start that settle the token, whatever follows.

    Two readings of a text that agree up to a boundary come apart there only if a
    merge (a, b) joins the last common token a with what one of them has behind it;
    the common part then ends one token a earlier, and b begins with the a of the
    merge that moved the boundary before. Merges of a chain come in list order, so
    the longest chain is found in one pass.
    """
    longest: dict[bytes, int] = {}
    best = 0
    for a, b in merges:
        before = max((longest.get(b[:k], 0) for k in range(1, len(b) + 1)), default=0)
        reach = len(a) + before
        if reach > longest.get(a, 0):
            longest[a] = reach
        best = max(best, reach)
    return best + 1


class Vocabulary:
    """Ids and merge ranks read from a tokenizer file with a byte-level BPE model."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols = byte_symbols()
        raw = lambda s: bytes(symbols[c] for c in s)
        model = spec["model"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in model["vocab"].items() if s not in special}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        merges = [(raw(a), raw(b)) for a, b in pairs]
        # A pair's key holds both ids; its value the rank, and below it the new id.
        self.shift = max(self.ids.values()).bit_length()
        self.mask = (1 << self.shift) - 1
        self.pairs = {self.ids[a] << self.shift | self.ids[b]: k << self.shift | self.ids[a + b] for k, (a, b) in enumerate(merges)}
        self.single = [self.ids.get(bytes([b]), -1) for b in range(256)]
        self.special = special
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in special.items()}
        self.lookahead = lookahead(merges)
        self.split = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        # Two generations: when the young one is full it becomes the old one.
        self.young: dict[str, Word] = {}
        self.old: dict[str, Word] = {}

    def remember(self, cut: str, word: Word) -> None:
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[cut] = word

    def forget(self) -> None:
        self.young, self.old = {}, {}


def merged(data: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of a window: merges apply lowest rank first and leftmost first."""
    pairs, shift = vocabulary.pairs, vocabulary.shift
    parts = [vocabulary.single[b] for b in data]
    none = NEVER
    if len(parts) < 100:
        order = [pairs.get(a << shift | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while order:
            best = min(order)
            if best is none:
                break
            at = order.index(best)
            parts[at] = new = best & vocabulary.mask
            del parts[at + 1], order[at]
            if at < len(order):
                order[at] = pairs.get(new << shift | parts[at + 1], none)
            if at:
                order[at - 1] = pairs.get(parts[at - 1] << shift | new, none)
        return parts
    after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
    heap = [(found, i) for i in range(len(parts) - 1) if (found := pairs.get(parts[i] << shift | parts[i + 1], none)) is not none]
    heapq.heapify(heap)
    while heap:
        found, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] < 0 or j < 0 or pairs.get(parts[i] << shift | parts[j], none) != found:
            continue
        parts[i], parts[j] = found & vocabulary.mask, -1
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] >= 0 and (p := pairs.get(parts[left] << shift | parts[after[left]], none)) is not none:
                heapq.heappush(heap, (p, left))
    return [p for p in parts if p >= 0]


class Transducer:
    """Reads the bytes of one pre-token in any pieces; emits ids once stable."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.pending = b""

    def feed(self, data: bytes) -> Iterator[int]:
        self.pending += data
        if len(self.pending) < 2 * self.vocabulary.lookahead:
            return
        settled = len(self.pending) - self.vocabulary.lookahead
        at = 0
        for part in merged(self.pending, self.vocabulary):
            if at > settled:
                break
            yield part
            at += len(self.vocabulary.bytes[part])
        self.pending = self.pending[at:]

    def end(self) -> Iterator[int]:
        yield from merged(self.pending, self.vocabulary)
        self.pending = b""


class Word(NamedTuple):
    """What a pre-token, or a run of them, encodes to: ids, and the same in decimals."""

    ids: tuple[int, ...]
    said: str


def _safe_pieces(text: str) -> Iterator[str]:
    """Pieces that the pattern splits as it splits the whole text: they are cut
    before a single space between two characters that are not white space."""
    start = 0
    while len(text) - start > PIECE and (cut := SAFE_CUT.search(text, start + PIECE)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _long(word: str, vocabulary: Vocabulary) -> Iterator[Word]:
    """Feed a long pre-token to the transducer bit by bit."""
    reader = Transducer(vocabulary)
    for at in range(0, len(word), FEED):
        yield Word(ids := tuple(reader.feed(word[at : at + FEED].encode())), ",".join(map(str, ids)))
    yield Word(ids := tuple(reader.end()), ",".join(map(str, ids)))


def _short(word: str, vocabulary: Vocabulary) -> Word:
    known = vocabulary.young.get(word) or vocabulary.old.get(word)
    if known is None:
        reader = Transducer(vocabulary)
        ids = (*reader.feed(word.encode()), *reader.end())
        known = Word(ids, ",".join(map(str, ids)))
    vocabulary.remember(word, known)
    return known


def _joined(found: list[Word]) -> Iterator[Word]:
    if found:
        yield Word(tuple(chain.from_iterable([w.ids for w in found])), ",".join([w.said for w in found]))


def _ordinary(text: str, vocabulary: Vocabulary) -> Iterator[Word]:
    """Encode text without special tokens."""
    for piece in _safe_pieces(text):
        words = (vocabulary.split if UNCOMMON.search(piece) else COMMON_SPLIT).findall(piece)
        found = list(map(vocabulary.young.get, words))
        if None in found:
            done = 0
            for k in [k for k, w in enumerate(found) if w is None]:
                if len(words[k]) > REMEMBERED_BYTES:
                    yield from _joined(found[done:k])
                    yield from (w for w in _long(words[k], vocabulary) if w.ids)
                    done = k + 1
                else:
                    found[k] = _short(words[k], vocabulary)
            found = found[done:]
        yield from _joined(found)


def encode(text: str, vocabulary: Vocabulary) -> Iterator[Word]:
    """Runs of the ids of a text. Strings of special tokens become their ids."""
    start = 0
    for mark in vocabulary.marks.finditer(text) if vocabulary.marks else ():
        if mark.start() > start:
            yield from _ordinary(text[start : mark.start()], vocabulary)
        yield Word((special := vocabulary.special[mark.group()],), str(special))
        start = mark.end()
    if start < len(text):
        yield from _ordinary(text[start:], vocabulary)


class Decoder:
    """Ids to text, in any pieces; bytes of an unfinished character wait."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.table = vocabulary.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def end(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


def round_trip(text: str, vocabulary: Vocabulary) -> tuple[int, str, str, bool]:
    """Count and digest of a text's ids, the digest of what they decode to, and
    whether that is the text. Ids are written out run by run."""
    ids_digest, text_digest, n, at, same = hashlib.sha256(), hashlib.sha256(), 0, 0, True
    decoder = Decoder(vocabulary)

    def take(said: str) -> None:
        nonlocal at, same
        same = same and text.startswith(said, at)
        at += len(said)
        text_digest.update(said.encode())

    for run in encode(text, vocabulary):
        if run.ids:
            ids_digest.update(("," * (n > 0) + run.said).encode())
            n += len(run.ids)
            take(decoder.feed(run.ids))
    take(decoder.end())
    return n, ids_digest.hexdigest(), text_digest.hexdigest(), same and at == len(text)


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every whole text and decode it again: the id column, ``n_tokens,
    ids_sha256, decoded_sha256, same_text``.

    Null texts are empty: no ids. Other columns are ignored, whatever their names.
    Repeated rows are all returned; an empty table gives an empty result.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path)
        gc.disable()  # nothing here is cyclic, and each collection walks all remembered words
        try:
            for batch in batches:
                found = [round_trip(t.as_py() or "", vocabulary) for t in batch.column(1)]
                cols = list(zip(*found, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:3]), pa.array(cols[3], pa.bool_())],
                    [id_column, "n_tokens", "ids_sha256", "decoded_sha256", "same_text"],
                )
        finally:
            # The worker goes on to other tasks, which need its memory and its collector.
            vocabulary.forget()
            gc.enable()

    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, same_text boolean"
    return docs.select(id_column, text_column).mapInArrow(run, schema)
