"""Near-duplicates by b-bit MinHash.

A document is the set of its distinct word shingles. Documents with equal sets are
one class. Every class gets ``VALUES`` MinHash values; ``BANDS`` hashes of ``ROWS``
values each make candidates, and the lowest ``BITS`` bits of every value are packed
into a signature of ``VALUES * BITS / 8`` bytes. Candidates whose similarity, as
estimated from the count of equal signature values and corrected for the values that
agree by chance, is not clearly below the threshold are confirmed on their full sets.

Pairs of similarity 0.8 share a band with a probability of 1 - 5e-6. No bucket is
cut: small ones give all their pairs; in large ones all members are first compared
with one leader, the member that shares most with all. Members that this leaves
outside the main component are then compared with all others of their cluster (what
large buckets join), block by block, inside tasks that confirm on full sets and
return only links between what was not connected: no more than they have rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.common import packed, spread, staged

ROWS = 6
BANDS = 40
VALUES = ROWS * BANDS
BITS = 2
#: Estimates below the threshold by so much cannot come from a link (six deviations).
SLACK = 0.19
#: Members of a bucket that gives all its pairs, and of a block of a cluster.
SMALL = 32
BLOCK = 256
#: Bytes of text that are hashed at once.
PIECE = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _RNG.integers(0, 2**31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TURN = _RNG.integers(0, 2**32, VALUES, dtype=np.uint32)
_STEP = np.uint64(0x100000001B3)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z in lower case."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64)
    # The place in its word weighs each byte; sums run over the words only.
    inner = np.flatnonzero(~space)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(inner)) - np.repeat(first, lengths)
    power = np.cumprod(np.full(int(lengths.max()), _STEP), dtype=np.uint64)
    value = _BYTE[_LOWER[raw[inner]]] * power[place]
    return spread(np.add.reduceat(value, first) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of ``width`` words; with fewer
    words the whole sequence is the one shingle, without words there is none."""
    words = word_hashes(data)
    width = min(width, len(words))
    if not width:
        return words
    n = len(words) - width + 1
    h = words[:n].copy()
    for k in range(1, width):
        h = h * np.uint64(0xC6A4A7935BD1E995) + words[k : k + n]
    return np.unique(spread(h + np.uint64(width)))


def minima(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set of hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        np.minimum(out, (((part[None, :] ^ _TURN[:, None]) * _MULTIPLY[:, None])).min(1), out=out)
    return out


def signature(values: np.ndarray) -> bytes:
    """The lowest bits of the values, packed."""
    bits = (values[:, None] >> np.arange(BITS, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def band_keys(values: np.ndarray) -> np.ndarray:
    h = np.zeros(BANDS, np.uint64)
    for column in values.reshape(BANDS, ROWS).T.astype(np.uint64):
        h = spread(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return (spread(h + np.arange(BANDS, dtype=np.uint64)) >> np.uint64(1)).astype(np.int64)


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarities estimated from rows of packed signatures (last axis), corrected
    for chance collisions of the kept bits."""
    differ = left ^ right
    pairs = differ | (differ >> 1)
    equal = VALUES - np.bitwise_count(pairs & 0x55).sum(-1, dtype=np.int64)
    chance = 2.0**-BITS
    return (equal / VALUES - chance) / (1 - chance)


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, mark, n_shingles, class (of the set), signature, bands``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
            for group in packed(sizes, PIECE):
                count, classes, packed_bits, bands = [], [], [], []
                for k in group:
                    found = shingle_hashes(texts[k].as_buffer().to_pybytes() if sizes[k] else b"", width)
                    count.append(len(found))
                    if not len(found):
                        classes.append(None), packed_bits.append(None), bands.append(None)
                        continue
                    mixed = spread(found)
                    classes.append(np.array([found.sum(dtype=np.uint64), mixed.sum(dtype=np.uint64)]).tobytes())
                    values = minima(found)
                    packed_bits.append(signature(values))
                    bands.append(band_keys(values))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(group.start, len(group)),
                        batch.column(1).slice(group.start, len(group)),
                        pa.array(count, pa.int64()),
                        pa.array(classes, pa.binary()),
                        pa.array(packed_bits, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "mark", "n_shingles", "class", "signature", "bands"],
                )

    schema = f"doc_id {kind}, mark long, n_shingles long, class binary, signature binary, bands array<long>"
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, schema)


def _passing(pairs: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """Pairs of ``a, b`` whose estimate is at least ``least``."""
    one = members.select(F.col("rep").alias("a"), F.col("signature").alias("sa"))
    two = members.select(F.col("rep").alias("b"), F.col("signature").alias("sb"))

    @F.pandas_udf("double")
    def estimate(left: pd.Series, right: pd.Series) -> pd.Series:
        as_rows = lambda s: np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1)
        return pd.Series(estimates(as_rows(left), as_rows(right)) if len(left) else np.empty(0))

    return pairs.join(one, "a").join(two, "b").filter(estimate("sa", "sb") >= least).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full sets are as similar as ``percent`` of 100, exactly."""
    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(maxsize=64)(lambda text: shingle_hashes(text, width))
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                mine, other = known(left.as_buffer().to_pybytes()), known(right.as_buffer().to_pybytes())
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(mine) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """``rep, root``: the least member of each component of the ``a, b`` links.

    Every round each vertex goes to the first of itself and its neighbours, in an
    order of hashes that changes from round to round, and on to where that one went.
    Then vertices that went to the same place are one, and only links between
    different ones are left, so links and vertices shrink by a share each round, in
    long chains too. All is written each round; nothing of it comes to the driver but
    whether links are left.
    """
    links = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = staged(links.filter("a <> b").distinct(), "links")
    labels: DataFrame | None = None
    rounds = 0
    while True:
        ranked = lambda v: F.struct(F.xxhash64(v, F.lit(rounds)).alias("rank"), F.col(v).alias("v"))  # noqa: B023, E731
        first = links.groupBy("a").agg(F.min(ranked("b")).alias("first"))
        hooks = staged(first.select(F.col("a").alias("rep"), F.least(ranked("a"), "first")["v"].alias("to")), "hooks")
        further = hooks.select(F.col("rep").alias("to"), F.col("to").alias("root"))
        hooks = staged(hooks.join(further, "to").select("rep", "root"), "hooks")
        if labels is None:
            labels = hooks
        else:
            moved = hooks.select(F.col("rep").alias("root"), F.col("root").alias("next"))
            labels = staged(labels.join(moved, "root", "left").select("rep", F.coalesce("next", "root").alias("root")), "labels")
        one = hooks.select(F.col("rep").alias("a"), F.col("root").alias("ra"))
        two = hooks.select(F.col("rep").alias("b"), F.col("root").alias("rb"))
        left = links.join(one, "a").join(two, "b").filter("ra <> rb")
        links = staged(left.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
        rounds += 1
        if not links.limit(1).count():
            least = labels.groupBy("root").agg(F.min("rep").alias("least"))
            return staged(labels.join(least, "root").select("rep", F.col("least").alias("root")), "labels")


def _stray_links(clusters: DataFrame, roots: DataFrame, members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between members of a cluster that are in different components.

    Members of a cluster's largest component need no comparison among themselves, so
    only the others ask, each of all members. A block of askers and a block of members
    make a group, so groups are bounded on both sides.
    """
    placed = clusters.join(roots, "rep", "left").select("cluster", "rep", F.coalesce("root", "rep").alias("root"))
    parts = placed.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("part"))
    open_ = (
        parts.groupBy("cluster")
        .agg(F.max_by("root", F.struct("part", "root")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("part").alias("size"))
        .filter("parts > 1")
        .select("cluster", "main", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), (F.col("parts") - 1).alias("strays"))
    )
    held = placed.join(open_, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = staged(texts(held.join(members, "rep")).select("cluster", "rep", "root", "main", "blocks", "block", "signature", "text"), "strays")
    strays = rows.filter("root <> main")
    columns = ["cluster", "part", "block", "rep", "root", "signature", "text", "asks"]
    asking = strays.withColumns({"part": F.col("block"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "asks": F.lit(True)})
    asked = strays.select("cluster", F.col("block").alias("part")).distinct()
    held = rows.join(asked, "cluster").withColumn("asks", F.lit(False))
    least = percent / 100 - SLACK

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ask, hold = group[group["asks"]], group[~group["asks"]]
        signatures = lambda f: np.frombuffer(b"".join(f["signature"]), np.uint8).reshape(len(f), -1)
        mine, other = signatures(ask), signatures(hold)
        sets = [shingle_hashes(t.encode(), width) for t in hold["text"]]
        sizes = np.array([len(x) for x in sets])
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up] = root.setdefault(up, up)
                x = root[x]
            return x

        out, reps = [], hold["rep"].tolist()
        homes = hold["root"].tolist()
        for k, (rep, home, text) in enumerate(zip(ask["rep"], ask["root"], ask["text"], strict=True)):
            near = np.flatnonzero(estimates(mine[k][None, :], other) >= least)
            near = [j for j in near if find(homes[j]) != find(home)]
            if not near:
                continue
            own = shingle_hashes(text.encode(), width)
            flat = np.concatenate([sets[j] for j in near])
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            edges = np.cumsum(sizes[near]) - sizes[near]
            both = np.add.reduceat((own[at] == flat).astype(np.int64), edges)
            linked = 100 * both >= percent * (len(own) + sizes[near] - both)
            for j in np.asarray(near)[linked]:
                p, q = find(homes[j]), find(home)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((min(rep, reps[j]), max(rep, reps[j])))
        return pd.DataFrame(out, columns=["a", "b"])

    both = asking.select(columns).union(held.select(columns))
    return both.groupBy("cluster", "part", "block").applyInPandas(compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Documents are linked if ``100 * shared >= percent * union`` of their shingle
    sets; ``component_id`` is the least ``doc_id`` that links reach, its own
    included. Null and empty texts, and texts without words, have no shingle and no
    link. Rows with a null ``doc_id`` are linked with nothing; their component is
    null, and they are kept. Repeated rows are all returned, alike; rows that share
    a ``doc_id`` but not the text are linked by their texts only. Other columns are
    ignored. An empty table gives an empty result.
    """
    sketches = staged(_sketches(docs, width), "sketches")
    known = sketches.filter(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    # Equal sets are one class; its first document stands for it.
    classes = staged(known.groupBy("class").agg(F.min(F.struct("doc_id", "mark")).alias("first")), "classes")
    own = known.join(
        classes.select(F.col("class").alias("rep"), "first"),
        (F.col("class") == F.col("rep")) & (F.col("doc_id") == F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")),
    )
    members = staged(
        own.select("rep", "first", "signature", "bands").dropDuplicates(["rep"]),
        "members",
    )
    banded = members.select("rep", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = staged(banded.join(sizes, "key"), "buckets")
    small, large = buckets.filter(F.col("size") <= SMALL), buckets.filter(F.col("size") > SMALL)
    # The leader of a large bucket shares the most buckets with the most others.
    weights = large.groupBy("rep").agg(F.sum("size").alias("weight"))
    leaders = large.join(weights, "rep").groupBy("key").agg(F.max_by("rep", F.struct("weight", "rep")).alias("leader"))
    stars = staged(large.join(leaders, "key").select(F.col("leader").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct(), "stars")
    least = percent / 100 - SLACK
    # In small buckets every member meets those before it, SMALL of them at most.
    pairs = (
        small.select("key", F.col("rep").alias("b"))
        .join(small.select("key", F.col("rep").alias("a")), "key")
        .filter("a < b")
        .select("a", "b")
        .union(stars)
        .distinct()
    )
    candidates = staged(_passing(pairs, members, least), "candidates")

    def with_texts(named: DataFrame) -> DataFrame:
        texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
        flat = named.withColumns({"doc_id": F.col("first.doc_id"), "mark": F.col("first.mark")})
        return texts.join(flat, ["doc_id", "mark"]).dropDuplicates(["rep"])  # of repeated rows

    needed = candidates.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    texts = staged(with_texts(members.join(needed, "rep").select("rep", "first")).select("rep", "text"), "texts")
    links = staged(_confirmed(candidates, texts, width, percent), "confirmed")
    roots = components(links)
    if stars.limit(1).count():
        clusters = components(stars).withColumnRenamed("root", "cluster")
        more = staged(_stray_links(clusters, roots, members, with_texts, width, percent), "stray-links")
        if more.limit(1).count():
            roots = components(links.union(more))
    rooted = classes.join(roots, F.col("class") == F.col("rep"), "left").select(
        "class", F.coalesce("root", "class").alias("root"), "first.doc_id"
    )
    least_id = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    placed = rooted.select("class", "root").join(least_id, "root").select("class", "component_id")
    named = sketches.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class"))
    component = F.coalesce("component_id", "doc_id")
    return named.join(placed, "class", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )
