"""Benchmark decontamination by size-partitioned MinHash containment search, on
DataFrame operations alone.

An item leaks into a document if at least ``CONTAINED`` of its distinct shingles of
``WORDS`` words are the document's. Items are short and documents long, so sketches
of whole documents would be blind: their Jaccard similarity with an item is tiny.
Two things make the sets comparable in size:

* Shingles that no item has cannot add to any containment, so documents are reduced
  to the shingles that some item of the size class has.
* Items are partitioned by size, and a document is also searched in windows twice
  as long as a class's items, overlapping by half: an unbroken leak lies whole in a
  window. The reduced whole document is searched too, for leaks in parts.

For a set of u shingles and items of at least q, a containment of t means a Jaccard
similarity of at least t q / (u + q - t q). From that each set's number of MinHash
values to search by is computed, so that a leak is missed with a probability below
``MISS`` (bands of one row: the similarities at stake are low). Where more than
``VALUES`` were needed, as in long documents that hold many items, the document is
searched exactly instead: a leak leaves out at most a fifth of an item's shingles, so
of any more of them, here the ones fewest items have, the document has one. All
candidates are verified by exact containment in the whole document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwarden.llm.common import bounded, staged

WORDS = 5
CONTAINED = 0.8
#: MinHash values of a sketch, and the probability of missing a leak by them; sets
#: that need more values are searched exactly.
VALUES = 64
MISS = 1e-6
#: Item shingles that are broadcast at most (16 bytes each); beyond it they are joined.
BROADCAST_ROWS = 1_000_000
#: Stands for the window that is the whole document.
WHOLE = -2


def _shingles(df: DataFrame, key: str) -> DataFrame:
    """``key, at, shingle`` of texts: runs of letters and digits, in lower case."""
    words = F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "")
    counted = df.select(F.col(key), words.alias("words")).filter(F.size("words") >= WORDS)
    # The outer form keeps Spark from splitting the text twice to filter first.
    each = counted.select(key, "words", F.explode_outer(F.sequence(F.lit(0), F.size("words") - WORDS)).alias("at"))
    return each.select(key, "at", F.xxhash64(*[F.col("words")[F.col("at") + k] for k in range(WORDS)]).alias("shingle"))


def _sketch(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Size and MinHash values of sets, given as distinct rows."""
    values = F.array(*[F.min(F.xxhash64("shingle", F.lit(k))) for k in range(VALUES)])
    return sets.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), values.alias("minima"))


def _needed(size, least):
    """MinHash values that a set of ``size`` needs for items of ``least`` shingles or more."""
    similarity = CONTAINED * least / (size + least - CONTAINED * least)
    return F.ceil(F.lit(math.log(MISS)) / F.log(1 - F.least(similarity, F.lit(0.999999)))).cast("int")


def _rarest(items: DataFrame) -> DataFrame:
    """``item_id, grade, shingle``: of each item one shingle more than a leak may
    lack, the ones that fewest items have, so a common phrase is not among them."""
    shared_by = items.groupBy("shingle").agg(F.count(F.lit(1)).alias("items"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("items", "shingle"))
    # A little less than the product, as rounding it up must not add one.
    held = F.ceil(CONTAINED * F.col("item_shingles") - 1e-6)
    ranked = items.join(shared_by, "shingle").withColumn("place", place)
    return ranked.filter(F.col("place") <= F.col("item_shingles") - held + 1).select("item_id", "grade", "shingle")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Items found in documents: ``doc_id, item_id, shared, item_shingles, containment``.

    Rows with the same ``doc_id`` (null included) are one document, and rows with
    the same ``item_id`` one item: their shingles are taken together. Null and empty
    texts, and texts of fewer than five words, have no shingles: such items are never
    found. Other columns are ignored. No item or no document gives no row.
    """
    items = staged(
        _shingles(benchmark.select("item_id", "text"), "item_id").select("item_id", "shingle").distinct(), "items"
    )
    sizes = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_shingles"))
    # Class c holds items of more than 2 ** (c - 1) and at most 2 ** c shingles.
    grade = F.ceil(F.log2(F.col("item_shingles"))).cast("int")
    items = staged(items.join(sizes.withColumn("grade", grade), "item_id"), "items-sized")
    wanted = bounded(staged(items.select("shingle", "grade").distinct(), "wanted"), BROADCAST_ROWS)

    found = _shingles(docs.select("doc_id", "text"), "doc_id").join(wanted, "shingle")
    hits = staged(found.select("doc_id", "grade", "at", "shingle"), "hits")

    stride = F.expr("shiftleft(1, grade)")
    window = F.floor(F.col("at") / stride).cast("int")
    places = hits.select(
        "doc_id", "grade", "shingle", F.explode(F.array(window, window - 1, F.lit(WHOLE))).alias("window")
    ).distinct()
    least = F.expr("shiftleft(1, grade) / 2") + F.when(F.col("grade") > 0, 1).otherwise(0.5)
    needed = _needed(F.col("size"), least)
    sketches = (
        _sketch(places, ["doc_id", "grade", "window"])
        .filter(F.col("size") >= CONTAINED * least)
        .withColumn("used", needed)
        .filter(F.col("used") <= VALUES)
        .select("doc_id", "grade", F.posexplode(F.slice("minima", F.lit(1), F.col("used"))).alias("band", "value"))
    )
    targets = _sketch(items.select("item_id", "grade", "shingle"), ["item_id", "grade"]).select(
        "item_id", "grade", F.posexplode("minima").alias("band", "value")
    )
    sketched = sketches.join(bounded(staged(targets, "targets"), BROADCAST_ROWS), ["grade", "band", "value"])

    # The whole document is the largest of its sets, so it needs most values.
    held = hits.select("doc_id", "grade", "shingle").distinct()
    large = held.groupBy("doc_id", "grade").agg(F.count(F.lit(1)).alias("size")).filter(needed > VALUES)
    large = staged(large.select(F.col("doc_id").alias("large_id"), F.col("grade").alias("large_grade")), "large-sets")
    in_large = held.join(
        bounded(large, BROADCAST_ROWS),
        F.col("doc_id").eqNullSafe(F.col("large_id")) & (F.col("grade") == F.col("large_grade")),
        "left_semi",
    )
    searched = in_large.join(bounded(staged(_rarest(items), "rarest"), BROADCAST_ROWS), ["grade", "shingle"])
    candidates = staged(
        sketched.select("doc_id", "item_id").union(searched.select("doc_id", "item_id")).distinct(), "candidates"
    )

    of_item = items.select("item_id", "item_shingles", "shingle")
    in_doc = hits.select(F.col("doc_id").alias("doc"), F.col("shingle").alias("has")).distinct()
    checked = candidates.join(of_item, "item_id").join(
        in_doc, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("shingle") == F.col("has"))
    )
    shared = checked.groupBy("doc_id", "item_id", "item_shingles").agg(F.count(F.lit(1)).alias("shared"))
    return shared.select(
        "doc_id", "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment")
    ).filter(F.col("containment") >= CONTAINED)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, in which no item was found."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("leaked")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["leaked"]), "left_anti")
