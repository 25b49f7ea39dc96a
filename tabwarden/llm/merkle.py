"""A Merkle manifest of a table as a persistent, path-copying tree.

A row is a leaf. The leaves of a source stand in the order of ``doc_id``; every
``ARITY`` consecutive nodes become the hash of their digests, level by level, until
one is left, the source's subroot. The subroots, in the order of their sources, grow
into the root the same way.

The tree is built in aligned blocks of ``ARITY ** BLOCK_LEVELS`` consecutive nodes: a
block is one small group of one task, whatever source it is from, and gives its
top node to the next round of blocks above. A tampered leaf makes a version of the
tree: within its block only the ancestors of the leaf are copied, all other nodes are
those of the original. Above the block the version goes on, in the same task, along
the path that the blocks above have written for the block's top node. So neither a
large source nor the versions of a whole table ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwarden.llm.common import staged

ARITY = 16
#: Levels of a block. A block has at most ARITY ** BLOCK_LEVELS nodes.
BLOCK_LEVELS = 2
BLOCK = ARITY**BLOCK_LEVELS

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A step up: the digests left and right of a node in its run, each side in one string.
Step = tuple[str, str]


def _digest(said: str) -> str:
    return sha256(said.encode()).hexdigest()


def grown(leaves: Sequence[str], levels: int) -> list[list[str]]:
    """The levels of a block over its leaves, the leaves first, the top last."""
    tree = [list(leaves)]
    for _ in range(levels):
        below = tree[-1]
        tree.append([_digest("".join(below[k : k + ARITY])) for k in range(0, len(below), ARITY)])
    return tree


def steps(tree: list[list[str]], place: int) -> list[Step]:
    """The siblings of a leaf and of its ancestors below the top, left and right."""
    found = []
    for nodes in tree[:-1]:
        first = place - place % ARITY
        found.append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + ARITY])))
        place //= ARITY
    return found


def copied_path(leaf: str, along: Sequence[Step]) -> list[str]:
    """The nodes that a version of the tree has of its own: the leaf and the copies of
    its ancestors, up to the top of ``along``. All others it shares."""
    nodes = [leaf]
    for left, right in along:
        nodes.append(_digest(left + nodes[-1] + right))
    return nodes


def levels_of(nodes: int) -> int:
    """How many levels grow over so many nodes until one is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


def _field(name: str, value: Column | None = None) -> Column:
    value = F.col(name).cast("string") if value is None else value
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, source, leaf, forged``: the leaf of every row, and its leaf after
    tampering (A-Z of the text in lower case) where 5 divides the crc32 of ``doc_id``."""
    forged = F.translate("text", _UPPER, _LOWER)
    plain = F.sha2(F.concat(*[_field(n) for n in FIELDS]), 256)
    other = F.sha2(F.concat(*[_field(n, forged if n == "text" else None) for n in FIELDS]), 256)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select("doc_id", "source", plain.alias("leaf"), F.when(chosen, other).alias("forged"))


def placed(rows: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """Add ``place`` (from 0) of each row in its group and ``among`` (rows of the group).

    Rows are dealt in ranges of the whole order, equal ones too, so a large group is
    ranked by many tasks; only the counts of (range, group) meet.
    """
    tie = F.monotonically_increasing_id()
    key = [*group, *order]
    ranged = rows.withColumn("tie", tie).repartitionByRange(*[F.asc_nulls_first(c) for c in [*key, "tie"]])
    ranged = staged(ranged.withColumn("part", F.spark_partition_id()), label)
    counts = ranged.groupBy("part", *group).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*group).orderBy("part") if group else Window.orderBy("part")
    along = before.rowsBetween(Window.unboundedPreceding, -1)
    every = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.select(
        F.col("part").alias("in_part"),
        *[F.col(c).alias(f"in_{c}") for c in group],
        F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"),
        F.sum("n").over(every).alias("among"),
    )
    inner = Window.partitionBy("part", *group).orderBy(*[F.asc_nulls_first(c) for c in [*order, "tie"]])
    local = ranged.withColumn("local", F.row_number().over(inner))
    same = F.col("part") == F.col("in_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"in_{c}"))
    place = (F.col("local") - 1 + F.col("before")).cast("long")
    return local.join(counts, same).select(*rows.columns, place.alias("place"), "among")


def _tops(nodes: DataFrame, kind: str) -> DataFrame:
    """The top of every block of ``source, place, among, node`` rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        among = int(group["among"].iloc[0])
        levels = min(BLOCK_LEVELS, levels_of(among))
        top = grown(group["node"].tolist(), levels)[-1]
        place = int(group["place"].iloc[0]) // BLOCK
        out = group[["source"]].iloc[:1].assign(place=place, among=-(-among // ARITY**levels), node=top[0])
        return out

    block = F.floor(F.col("place") / BLOCK).alias("block")
    schema = f"source {kind}, place long, among long, node string"
    return nodes.groupBy(F.col("source"), block).applyInPandas(run, schema)


def _paths(nodes: DataFrame, above: DataFrame | None, kind: str) -> DataFrame:
    """``source, place, lefts, rights``: the steps of every node up to the end of the
    tree, given those of the blocks' tops (``above``; none if the blocks are all)."""
    schema = f"source {kind}, place long, lefts array<string>, rights array<string>"

    def run(group: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        tree = grown(group["node"].tolist(), min(BLOCK_LEVELS, levels_of(int(group["among"].iloc[0]))))
        more = list(zip(up["lefts"].iloc[0], up["rights"].iloc[0], strict=True)) if len(up) else []
        along = [steps(tree, k) + more for k in range(len(group))]
        out = group[["source", "place"]].copy()
        out["lefts"] = [[left for left, _ in x] for x in along]
        out["rights"] = [[right for _, right in x] for x in along]
        return out

    block = F.floor(F.col("place") / BLOCK).alias("block")
    if above is None:
        none = pd.DataFrame({"lefts": [], "rights": []})
        return nodes.groupBy("source", block).applyInPandas(lambda g: run(g, none), schema)
    theirs = above.withColumnRenamed("place", "block").groupBy("source", "block")
    return nodes.withColumn("block", block).groupBy("source", "block").cogroup(theirs).applyInPandas(run, schema)


def _raised(nodes: DataFrame, kind: str, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of blocks: the nodes that each round starts from, and what is left, one
    node for each source. The first round is the nodes given."""
    rounds = [nodes]
    while True:
        tops = staged(_tops(rounds[-1], kind), label)
        if not tops.filter("among > 1").limit(1).count():
            return rounds, tops
        rounds.append(tops)


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, copied`` of
    every row.

    ``proof_sha256`` digests the siblings of the leaf and of its ancestors, level by
    level. ``folded_root`` is the root of the version that the row's tampered leaf makes,
    or, if it is not tampered with, of the tree that its original leaf gives;
    ``verified`` tells whether it is the root. ``copied`` counts the nodes that the
    version has of its own (0 if no byte changed); it shares all others.

    Any field may be null, a null source is a source of its own and comes first, and
    rows of a null ``doc_id`` come first and are not tampered with. Rows with the same
    source and ``doc_id`` are ordered by their leaves; equal rows are leaves of their
    own, side by side. Empty texts are hashed like others. Other columns are ignored.
    An empty table gives an empty result.
    """
    kind = docs.schema["source"].dataType.simpleString()
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    rows = staged(placed(leaves(docs), ["source"], ["doc_id", "leaf"], "leaf-ranges"), "leaves")
    own = rows.select("source", "place", "among", F.col("leaf").alias("node"))
    rounds, subroots = _raised(own, kind, "subtrees")

    # The sources' tree: one group, whose nodes are named by the source they stand for.
    ranked = staged(placed(subroots.select(F.col("source").alias("of"), "node"), [], ["of"], "source-ranges"), "sources")
    upper = ranked.select(F.lit(None).cast(kind).alias("source"), "place", "among", "node")
    upper_rounds, root = _raised(upper, kind, "root")

    above: DataFrame | None = None
    for nodes in reversed(upper_rounds):
        above = staged(_paths(nodes, above, kind), "root-paths")
    up = above.select("place", "lefts", "rights")
    above = ranked.join(up, "place").select(F.col("of").alias("source"), F.lit(0).cast("long").alias("place"), "lefts", "rights")
    for nodes in reversed(rounds[1:]):
        above = staged(_paths(nodes, above, kind), "subtree-paths")

    end = root.first()  # one row, or none of an empty table
    whole = end["node"] if end else ""
    subs = subroots.select(F.col("source").alias("of_source"), F.col("node").alias("subroot"))
    above = above.join(subs, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")

    def fold(group: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        original = group["leaf"].tolist()
        levels = min(BLOCK_LEVELS, levels_of(int(group["among"].iloc[0])))
        tree = grown(original, levels)
        more = list(zip(up["lefts"].iloc[0], up["rights"].iloc[0], strict=True))
        further = "".join(left + right for left, right in more)
        out = group[["doc_id", "leaf"]].copy()
        proofs, folded, copied = [], [], []
        for k, (leaf, forged) in enumerate(zip(original, group["forged"], strict=True)):
            within = steps(tree, k)
            proofs.append(_digest("".join(left + right for left, right in within) + further))
            version = copied_path(forged if isinstance(forged, str) else leaf, within)
            upper = copied_path(version[-1], more)
            folded.append(upper[-1])
            copied.append(len(within) + len(upper) if isinstance(forged, str) and forged != leaf else 0)
        out["subroot"], out["root"], out["proof_sha256"] = up["subroot"].iloc[0], whole, proofs
        out["folded_root"], out["verified"], out["copied"] = folded, [x == whole for x in folded], copied
        return out

    schema = f"doc_id {id_kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied int"
    mine = rows.withColumn("block", F.floor(F.col("place") / BLOCK)).groupBy("source", "block")
    theirs = above.withColumnRenamed("place", "block").groupBy("source", "block")
    return mine.cogroup(theirs).applyInPandas(fold, schema)

