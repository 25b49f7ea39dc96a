"""Joins and ordered windows that survive one key holding much of the data."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that are dealt into pieces, and rows from which on a key is. Any key left out
#: holds less than 1/HOT_KEYS of the rows.
HOT_KEYS = 1000
SPLIT_ROWS = 100_000

#: Rows from which a key is windowed in segments, and sequence numbers per segment.
SEGMENT_SPAN = 1_000_000

#: Keys that may be segmented. Only their names are broadcast.
SEGMENTED_KEYS = 10_000


def join_per_key(
    facts: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    weight: str,
    spread_by: str,
    null_safe: Collection[str] = (),
) -> DataFrame:
    """Left-join ``per_key`` (one row per key) to ``facts`` when keys may be hot.

    ``weight`` is the column of ``per_key`` counting the fact rows of a key. The
    fact rows of a key of more than ``SPLIT_ROWS`` are dealt into pieces of about
    that many by ``spread_by``, and its row of ``per_key`` is repeated for each
    piece. Only hashes of the hot keys and their numbers of pieces are broadcast,
    two numbers each, however long keys and payload are. Each fact row appears
    exactly once in the result, with NULLs where no key matched. ``weight`` is
    kept.

    A NULL matches nothing, and such fact rows are dealt over all partitions; in
    the keys named by ``null_safe`` NULL matches NULL.
    """
    payload = [name for name in per_key.columns if name not in keys]
    hashed = F.xxhash64(*keys).alias("__hash")
    heavy = per_key.filter(F.col(weight) > SPLIT_ROWS).select(hashed, F.col(weight).alias("__n"))
    heavy = heavy.orderBy(F.desc("__n"), "__hash").limit(HOT_KEYS)
    # Both sides take the pieces of a hash from here, so keys of one hash stay together.
    heavy = heavy.groupBy("__hash").agg(F.ceil(F.max("__n") / SPLIT_ROWS).cast("bigint").alias("__pieces"))
    pieces = F.coalesce("__pieces", F.lit(1).cast("bigint"))
    dealt = F.xxhash64(spread_by)
    matchless = F.lit(False)
    for name in keys:
        if name not in null_safe:
            matchless = matchless | F.col(name).isNull()
    spread = F.when(matchless, dealt).otherwise(F.pmod(dealt, pieces))
    marked = facts.withColumn("__hash", hashed).join(F.broadcast(heavy), "__hash", "left")
    marked = marked.select(*[F.col(name) for name in facts.columns], spread.alias("__spread"))
    copies = per_key.withColumn("__hash", hashed).join(F.broadcast(heavy), "__hash", "left").select(
        *[F.col(name).alias(f"__key{n}") for n, name in enumerate(keys)],
        F.struct(*payload).alias("__found"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)).alias("__piece"),
    )
    same = F.col("__spread") == F.col("__piece")
    for n, name in enumerate(keys):
        left, right = F.col(name), F.col(f"__key{n}")
        same = same & (left.eqNullSafe(right) if name in null_safe else left == right)
    joined = marked.join(copies, same, "left")
    return joined.select(
        *[F.col(name) for name in facts.columns],
        *[F.col("__found").getField(name).alias(name) for name in payload],
    )


def _segmented(df: DataFrame, keys: Sequence[str], order: str, span: int) -> DataFrame:
    """Add ``__segment``: parts of the sequence for the largest keys, 0 for others.

    Key sizes are counted with a combine before the shuffle.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > span)
    large = sizes.orderBy(F.desc("__n"), *keys).limit(SEGMENTED_KEYS)
    large = large.select(*keys, F.lit(True).alias("__large"))
    part = F.floor(F.col(order) / F.lit(span)).cast("bigint")
    marked = df.join(F.broadcast(large), list(keys), "left")
    segment = F.when(F.col("__large"), part).otherwise(F.lit(0).cast("bigint"))
    return marked.withColumn("__segment", segment)


@dataclass(frozen=True)
class Running:
    """A running ``sum`` or ``max``, up to and with the row, or before it."""

    value: Column
    how: str = "sum"
    inclusive: bool = True

    @property
    def combine(self) -> Callable[[Column | str], Column]:
        return {"sum": F.sum, "max": F.max}[self.how]

    def merged(self, carry: Column, within: Column) -> Column:
        if self.how == "max":
            return F.greatest(carry, within)
        return F.coalesce(carry, F.lit(0)) + F.coalesce(within, F.lit(0))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: dict[str, Running],
    span: int = SEGMENT_SPAN,
) -> DataFrame:
    """Add running values per key in ``order``, a whole-number sequence.

    A plain window would sort every row of a key in one task. Here the window of a
    large key runs per segment of the sequence, and the totals of its segments
    carry over between them. All rows are shuffled once.
    """
    rows = _segmented(df, keys, order, span)
    for name, spec in columns.items():
        rows = rows.withColumn(f"__v_{name}", spec.value)
    group = [*keys, "__segment"]
    totals = rows.filter("__large").groupBy(*group).agg(
        *[spec.combine(f"__v_{name}").alias(f"__t_{name}") for name, spec in columns.items()]
    )
    before = Window.partitionBy(*keys).orderBy("__segment").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = totals.select(
        *group,
        *[
            spec.combine(f"__t_{name}").over(before).alias(f"__c_{name}")
            for name, spec in columns.items()
        ],
    )
    joined = rows.join(totals, group, "left")
    within = Window.partitionBy(*group).orderBy(order)
    results = []
    for name, spec in columns.items():
        frame = within.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
        inner = spec.combine(f"__v_{name}").over(frame)
        results.append(spec.merged(F.col(f"__c_{name}"), inner).alias(name))
    return joined.select(*[F.col(name) for name in df.columns], *results)


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: dict[str, str],
    forward: bool = False,
    span: int = SEGMENT_SPAN,
) -> DataFrame:
    """Add values of the previous (or next) row per key in ``order``.

    ``columns`` maps a new name to the column it copies. The edge row of every
    segment of a large key is aggregated first, so it is never sorted in one task.
    """
    rows = _segmented(df, keys, order, span)
    group = [*keys, "__segment"]
    image = F.struct(*[F.col(source).alias(name) for name, source in columns.items()])
    pick, step = (F.min_by, F.lead) if forward else (F.max_by, F.lag)
    edges = rows.filter("__large").groupBy(*group).agg(pick(image, F.col(order)).alias("__edge"))
    across = Window.partitionBy(*keys).orderBy("__segment")
    edges = edges.select(*group, step("__edge").over(across).alias("__carry"))
    within = Window.partitionBy(*group).orderBy(order)
    joined = rows.join(edges, group, "left").withColumn("__image", image)
    joined = joined.withColumn("__near", F.coalesce(step("__image").over(within), "__carry"))
    return joined.select(
        *[F.col(name) for name in df.columns],
        *[F.col("__near").getField(name).alias(name) for name in columns],
    )
