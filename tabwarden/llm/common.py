"""Shared helpers: written intermediates, bounded labelled samples, byte tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a session with a local master may go without that setting; it then gets
    a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "tabwarden-llm")


#: Spark's own setting: an SQL execution deletes its shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    With ``tidy``, the shuffle files of the write go with it, so an operator of many
    steps needs disk for the largest of them, not for their sum.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if tidy:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a ``staged`` table that no later step reads."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    learn_from,
    rows: int,
    text_bytes: int,
) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts, ``text_bytes`` bytes in all, for fitting.

    Takes the labelled documents that ``learn_from`` (a condition on ``doc_id``)
    allows, in the order of a hash of ``doc_id``, so the sample does not depend on
    the order of rows. Texts of more than a hundredth of ``text_bytes`` come after all
    others, the shortest first, so a long text never ends the sample before a shorter
    one. A document with several labels counts with the largest, and repeated rows
    count once. Rows with a null id, label or text take no part, nor do labels of
    documents not in ``docs``.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learn_from)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).withColumn("mark", F.xxhash64("text"))
    place = [F.greatest("size", F.lit(text_bytes // 100)), F.xxhash64("doc_id"), F.col("doc_id"), F.col("mark")]
    # At most `rows` narrow rows, so the window and the broadcast are bounded.
    found = (
        texts.select("doc_id", "mark", F.octet_length("text").alias("size"))
        .join(ids, "doc_id")
        .dropDuplicates(["doc_id", "mark"])
        .orderBy(*place)
        .limit(rows)
    )
    order = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    kept = (
        found.withColumn("upto", F.sum("size").over(order))
        .filter(F.col("upto") <= text_bytes)
        .select("doc_id", "mark", "label")
    )
    chosen = texts.join(F.broadcast(kept), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    rows_ = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("text", "label").collect()
    return [(r.text, int(r.label)) for r in rows_]


def slices(text: str, limit: int) -> Iterator[str]:
    """Cut a text into pieces of about ``limit`` characters, at white space if any
    is near; nothing is lost, and a text within the limit is one piece."""
    start, n = 0, len(text)
    while n - start > limit:
        cut = max(text.rfind(" ", start + limit // 2, start + limit), text.rfind("\n", start + limit // 2, start + limit))
        cut = cut + 1 if cut > start else start + limit
        yield text[start:cut]
        start = cut
    yield text[start:]


def packed(sizes: list[int], limit: int) -> Iterator[range]:
    """Ranges of consecutive items of at most ``limit`` in all, or one large item."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield range(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield range(start, len(sizes))


def spread(values: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit integers."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if ``df`` has at most so many (narrow) rows; else Spark joins
    it by shuffling. ``df`` should be a written table, as its rows are counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
