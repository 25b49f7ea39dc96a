"""Sharding by proportional stratified interleaving, on DataFrame operations alone.

Rows of each source are shuffled by a seeded hash and ranked. The fractional rank,
(rank - phase) / rows of the source, spreads every source evenly over [0, 1); the
rows of all sources sorted by it interleave in proportion. The sorted rows are cut
into shards whose counts differ by one at most, so each shard holds the mixture.

No sort or rank takes a whole source, however large: rows are dealt into buckets by
the high bits of their hash (and later of their fractional rank), buckets are
counted, and a rank is the count of the buckets before plus the rank in the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwarden.llm.common import staged

#: Rows that a bucket holds on average, at most.
BUCKET_ROWS = 20_000


def _unit(h: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def shard(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """Deal rows to ``shards`` shards: ``doc_id, source, size, text_crc32, shard, slot``.

    Sizes are UTF-8 bytes of the text and one; a null text has none. A null source
    is a source of its own. Every row is dealt, repeated rows too (equal rows are
    interchangeable). Slots count from 0 in each shard, without gaps. Counts of
    shards differ by one at most; with fewer rows than shards some have none. An
    empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(
        docs.select(
            "doc_id",
            "source",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("stratum"),
            F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("row")).alias("mix"),
        ),
        "shard-rows",
    )
    total = rows.count()
    buckets = max(1, total // BUCKET_ROWS)

    # Ranks within each source.
    rows = rows.withColumn("bucket", F.floor(_unit(F.col("mix")) * buckets).cast("int"))
    source = Window.partitionBy("stratum")
    upto = source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        rows.groupBy("stratum", "bucket")
        .count()
        .withColumn("before", F.coalesce(F.sum("count").over(upto), F.lit(0)))
        .withColumn("of_source", F.sum("count").over(source))
        .select("stratum", "bucket", "before", "of_source")
    )
    within = Window.partitionBy("stratum", "bucket").orderBy("mix", "doc_id", "text_crc32", "size")
    phase = _unit(F.xxhash64(F.lit(seed), F.col("stratum"), F.lit("phase")))
    ranked = rows.join(sizes, ["stratum", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(within))
    placed = ranked.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        "stratum",
        "mix",
        ((F.col("rank") - phase) / F.col("of_source")).alias("place"),
    )

    # Ranks of all rows by their place.
    placed = staged(placed.withColumn("bucket", F.floor(F.col("place") * buckets).cast("int")), "shard-places")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each bucket: its window is one task over rows / BUCKET_ROWS rows.
    sizes = placed.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("bucket").orderBy("place", "stratum", "mix", "doc_id", "text_crc32", "size")
    n = max(total, 1)
    at = placed.join(sizes, "bucket").withColumn("at", F.col("before") + F.row_number().over(within) - 1)
    cut = at.withColumn("shard", F.expr(f"cast((at * {shards}) div {n} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")
    return cut.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("at") - first).cast("long").alias("slot"))
