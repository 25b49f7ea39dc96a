"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: every node has a random direction and the
median of the sample's projections. All vectors are then dealt to the leaves of all
trees. A query walks the forest through one shared priority queue, so the leaves of
all trees come in the order of how far beyond their splits the query lies; it visits
as many leaves as the sample needs for ``TARGET`` recall against brute force. What
lies in the visited leaves is ranked exactly, by inner products in double precision
of the original vectors.

Equal vectors are one class: the forest holds each class once, with its smallest
ids, which are all that a list of nearest can need; so a vector shared by a third
of the rows costs one row. Leaves are cut into blocks of vectors and blocks of
queries, which bounds every task. A task returns the best few of each query, only
those no further than as many that it meets of the sample, and each pair from the first
tree alone in which the query visits the vector's leaf.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwarden.llm.common import staged

TREES = 8
DEPTH = 8
#: Vectors that the trees are fitted on, and queries that the search is tuned on.
SAMPLE = 8_192
TUNING = 128
#: Recall on the sample that decides how many leaves a query visits.
TARGET = 0.96
#: Vectors, and queries, in a block.
BLOCK = 4_096


@dataclass
class Forest:
    planes: np.ndarray  # TREES, 2 ** DEPTH - 1, dimensions
    offsets: np.ndarray  # TREES, 2 ** DEPTH - 1
    visits: int
    sample: np.ndarray
    sample_leaves: np.ndarray | None = None

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree: vectors, TREES."""
        out = np.zeros((len(vectors), len(self.planes)), np.int32)
        for t, (planes, offsets) in enumerate(zip(self.planes, self.offsets, strict=True)):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(DEPTH):
                above = np.einsum("ij,ij->i", vectors, planes[node]) > offsets[node]
                node = 2 * node + 1 + above
            out[:, t] = node - (2**DEPTH - 1)
        return out

    def search(self, query: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """The first ``visits`` leaves of the shared queue: tree, leaf."""
        margins = np.einsum("tnd,d->tn", self.planes, query) - self.offsets
        queue = [(0.0, t, 0) for t in range(len(margins))]
        inner, found = 2**DEPTH - 1, []
        while queue and len(found) < visits:
            far, t, node = heapq.heappop(queue)
            if node >= inner:
                found.append((t, node - inner))
                continue
            margin = margins[t, node]
            near = 2 * node + 1 + int(margin > 0)
            heapq.heappush(queue, (far, t, near))
            # The squares of the margins on the way add up.
            heapq.heappush(queue, (far + margin * margin, t, 4 * node + 3 - near))
        return found


def fit(sample: np.ndarray, k: int, seed: int = 5) -> Forest:
    """Fit trees on a sample, and the number of leaves to visit for its recall."""
    rng = np.random.default_rng(seed)
    nodes = 2**DEPTH - 1
    planes = rng.standard_normal((TREES, nodes, sample.shape[1]))
    planes /= np.linalg.norm(planes, axis=2, keepdims=True)
    offsets = np.zeros((TREES, nodes))
    for t in range(TREES):
        node = np.zeros(len(sample), np.int64)
        for level in range(DEPTH):
            height = np.einsum("ij,ij->i", sample, planes[t, node])
            order = np.lexsort((height, node))
            first = np.searchsorted(node[order], np.arange(2**level - 1, 2 ** (level + 1)))
            for i in range(2**level):
                held = height[order[first[i] : first[i + 1]]]
                offsets[t, 2**level - 1 + i] = held[(len(held) - 1) // 2] if len(held) else 0.0
            node = 2 * node + 1 + (height > offsets[t, node])
    forest = Forest(planes, offsets, TREES * 2**DEPTH, sample)
    forest.sample_leaves = leaves = forest.leaves(sample)
    asked = rng.choice(len(sample), min(TUNING, len(sample)), replace=False)
    near = min(k, len(sample) - 1)
    if near < 1:
        return forest
    # For each query, the visit that first meets each of its true neighbours.
    met = []
    for i in asked:
        likeness = sample @ sample[i]
        likeness[i] = -np.inf
        best = np.argpartition(-likeness, near - 1)[:near]
        when = np.full((TREES, 2**DEPTH), TREES * 2**DEPTH)
        for n, (t, leaf) in enumerate(forest.search(sample[i], TREES * 2**DEPTH)):
            when[t, leaf] = n
        met.append(when[np.arange(TREES), leaves[best]].min(1))
    forest.visits = int(np.quantile(np.concatenate(met), TARGET)) + 1
    return forest


def _usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding (doubles)`` of vectors that can be compared."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", wide.alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite & some)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, the
    rows whose ``vec_id`` is divisible by ``every``, among all other rows.

    Nearness is the inner product; ties go to the smaller ``vec_id``. Vectors that
    are null, zero, or hold null or non-finite components, and rows with a null id,
    take no part, nor do vectors whose length is not the most common one. Rows that
    share an id and a vector are one; with different vectors they are separate
    candidates of one id, and a query never finds its own id. Other columns are
    ignored. Fewer than ``k`` candidates give fewer rows.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors)
    sizes = usable.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not sizes:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    # The key of a class: the digest of its components, with one zero.
    text = F.concat_ws(",", F.transform("embedding", lambda x: (x + 0.0).cast("string")))
    keyed = usable.filter(F.size("embedding") == sizes[0].n).withColumn("class", F.unhex(F.sha2(text, 256)))
    keyed = staged(keyed.dropDuplicates(["vec_id", "class"]), "vectors")
    # k + 1 ids of a class are enough for any list; the cut is made before the shuffle too.
    first = Window.partitionBy("class").orderBy("vec_id")
    ids = keyed.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
    classes = staged(
        ids.groupBy("class").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding")),
        "classes",
    )
    sample = classes.orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("embedding").collect()
    forest = fit(np.array([r.embedding for r in sample]), k)
    shared = spark.sparkContext.broadcast(forest)

    def dealt(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = shared.value.leaves(np.stack(batch["embedding"].to_numpy()))
                yield batch.assign(leaves=list(found))

    def asked(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            visited, least = [], []
            for query in batch["embedding"]:
                seen = np.zeros((TREES, 2**DEPTH), bool)
                seen[tuple(np.array(known.search(np.asarray(query), known.visits)).T)] = True
                visited.append(np.packbits(seen).tobytes())
                # What it meets of the sample it is sure to find.
                met = seen[np.arange(TREES), known.sample_leaves].any(1)
                likeness = known.sample[met] @ np.asarray(query)
                least.append(np.partition(likeness, -k - 1)[-k - 1] - 1e-9 if len(likeness) > k else -np.inf)
            yield batch.assign(visited=visited, least=least)

    held = classes.select("class", "embedding").mapInPandas(dealt, "class binary, embedding array<double>, leaves array<int>")
    # Leaves stand in order, so a run of them is a subtree: cells of about BLOCK vectors.
    total = classes.count()
    cells = int(min(2**DEPTH, max(1, 2 ** int(np.ceil(np.log2(max(1.0, total / BLOCK)))))))
    width = 2**DEPTH // cells
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    held = staged(held, "leaves").select("class", "embedding", "leaves", tree)
    held = held.withColumn("cell", (F.get("leaves", F.col("tree")) / width).cast("int"))
    queries = keyed.filter(F.expr(f"vec_id % {every} = 0")).select("class").distinct().join(classes.select("class", "embedding"), "class")
    visits = staged(queries.mapInPandas(asked, "class binary, embedding array<double>, visited binary, least double"), "visits")

    @F.pandas_udf("array<int>")
    def to_cells(visited: pd.Series) -> pd.Series:
        """Cells that a query visits, numbered through all trees."""
        seen = np.unpackbits(np.frombuffer(b"".join(visited), np.uint8)).reshape(len(visited), TREES * cells, width)
        return pd.Series([np.flatnonzero(x).astype(np.int32) for x in seen.any(2)])

    at = F.explode(to_cells("visited")).alias("at")
    visiting = visits.select("class", "embedding", "visited", "least", at)
    visiting = visiting.withColumns({"tree": F.expr(f"at div {cells}").cast("int"), "cell": (F.col("at") % cells).cast("int")})
    # A crowded cell, or one with many queries, is cut into blocks that all meet.
    vectors_in = held.groupBy("tree", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("vector_blocks"))
    queries_in = visiting.groupBy("tree", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("query_blocks"))
    blocks = F.broadcast(vectors_in.join(queries_in, ["tree", "cell"]))  # TREES * 2 ** DEPTH rows at most
    mine = F.pmod(F.xxhash64("class"), F.col("vector_blocks")).cast("int")
    theirs = F.pmod(F.xxhash64("class"), F.col("query_blocks")).cast("int")
    vectors_side = held.join(blocks, ["tree", "cell"]).select(
        "tree", "cell", mine.alias("vector_block"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"),
        "class", "embedding", "leaves", F.lit(None).cast("binary").alias("visited"), F.lit(None).cast("double").alias("least"),
    )
    queries_side = visiting.join(blocks, ["tree", "cell"]).select(
        "tree", "cell", F.explode(F.sequence(F.lit(0), F.col("vector_blocks") - 1)).alias("vector_block"), theirs.alias("query_block"),
        "class", "embedding", F.lit(None).cast("array<int>").alias("leaves"), "visited", "least",
    )

    def best(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["visited"].notna().to_numpy()
        ask, hold = group[asks], group[~asks]
        if not len(ask) or not len(hold):
            return pd.DataFrame({"asker": [], "class": [], "score": []})
        q, v = np.stack(ask["embedding"].to_numpy()), np.stack(hold["embedding"].to_numpy())
        leaves, asker, other = np.stack(hold["leaves"].to_numpy()), ask["class"].to_numpy(), hold["class"].to_numpy()
        seen = np.unpackbits(np.frombuffer(b"".join(ask["visited"]), np.uint8)).reshape(len(q), TREES, -1).astype(bool)
        own, least = int(group["tree"].iloc[0]), ask["least"].to_numpy()
        out = []
        for at in range(0, len(q), 256):
            part = slice(at, at + 256)
            score = np.where(seen[part, own][:, leaves[:, own]], q[part] @ v.T, -np.inf)
            top = min(k + 1, score.shape[1])
            # Ties at the edge all pass, so that the smaller id is never lost.
            edge = -np.partition(-score, top - 1, axis=1)[:, top - 1]
            i, j = np.nonzero((score >= np.maximum(edge, least[part])[:, None]) & (score > -np.inf))
            new = ~seen[at + i[:, None], np.arange(own)[None, :], leaves[j][:, :own]].any(1)
            i, j = i[new], j[new]
            out.append(pd.DataFrame({"asker": asker[at + i], "class": other[j], "score": score[i, j]}))
        return pd.concat(out)

    found = (
        vectors_side.unionByName(queries_side)
        .groupBy("tree", "cell", "vector_block", "query_block")
        .applyInPandas(best, "asker binary, class binary, score double")
    )
    # Block products may differ in the last digits: near ties all go on to be ranked.
    few = found.groupBy("asker", "class").agg(F.max("score").alias("score"))
    few = few.withColumn("nth", F.dense_rank().over(Window.partitionBy("asker").orderBy(F.desc(F.round("score", 9)))))
    few = few.filter(F.col("nth") <= k + 1)
    return _ranked(few, classes, keyed, k, every)


def _ranked(found: DataFrame, classes: DataFrame, keyed: DataFrame, k: int, every: int) -> DataFrame:
    """Score pairs of classes one by one, and list ids for each query row."""

    @F.pandas_udf("double")
    def product(left: pd.Series, right: pd.Series) -> pd.Series:
        if not len(left):
            return pd.Series([], dtype=float)
        return pd.Series((np.stack(left.to_numpy()) * np.stack(right.to_numpy())).sum(1))

    own = classes.select(F.col("class").alias("asker"), F.col("embedding").alias("asked"))
    other = classes.select("class", "ids", "embedding")
    scored = found.select("asker", "class").join(own, "asker").join(other, "class")
    pairs = scored.select("asker", product("asked", "embedding").alias("score"), F.explode("ids").alias("vec_id"))
    # k + 1 rows for each asking class: its own row may be among them.
    place = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    listed = pairs.dropDuplicates(["asker", "vec_id", "score"]).withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= k + 1)
    lists = listed.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("list"))
    rows = keyed.filter(F.expr(f"vec_id % {every} = 0")).select(F.col("vec_id").alias("query_id"), F.col("class").alias("asker"))
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return rows.join(lists, "asker").select("query_id", F.posexplode(others).alias("at", "found")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "found.vec_id", "found.score"
    )
