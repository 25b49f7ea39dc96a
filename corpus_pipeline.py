"""A corpus pipeline of five stages over the documents table.

Each stage works on what the one before kept. Between stages the documents are
written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.llm import bpe, decontamination, line_dedup, near_dedup, quality
from tabwarden.llm.common import fresh, staged
from tabwarden.llm.queries import BYTE_BPE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier accepts; columns stay as they are.

    Every row is judged by its text alone; null and empty texts have a score as well.
    Without labels nothing is known, so all are kept.
    """
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), F.lit(True))
    return docs.filter(quality.scorer(model, docs)(F.col("text")) >= 0.5)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete the later copies of repeated lines; documents of which nothing is left
    are dropped. ``n_chars`` follows the text."""
    removed = fresh(docs, "removed_lines")
    cut = line_dedup.without_lines(docs, line_dedup.repeated_lines(docs), removed=removed)
    cut = cut.filter((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        counted = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col(removed) > 0, counted).otherwise(F.col("n_chars")))
    return cut.drop(removed)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near-duplicates, once.

    A document is known by id and text: rows of one id and other texts are judged each
    by its own text, equal rows are one document. Documents with a null id, and those
    without words, are near-duplicates of nothing and stay.
    """
    mark = F.xxhash64("text").alias("mark")
    known = docs.select(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", mark)).alias("doc_id"), "text")
    found = near_dedup.near_duplicates(known, width=5, percent=80)
    copies = found.filter(~F.col("kept")).select(F.col("doc_id.doc_id").alias("copy"), F.col("doc_id.mark").alias("copy_mark"))
    dropped = staged(copies.distinct(), "near-copies")
    kept = docs.join(dropped, (docs["doc_id"] == dropped["copy"]) & (F.xxhash64(docs["text"]) == dropped["copy_mark"]), "left_anti")
    # Whole rows are compared only if some id stands in two rows of one text.
    repeated = docs.groupBy("doc_id", mark).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return kept.dropDuplicates(["doc_id", "text"]) if repeated.limit(1).count() else kept


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item; all rows of such an id go. Null
    and empty texts hold none."""
    return decontamination.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Count and digest the ids of every row, and of what they decode to; a null text is
    an empty one."""
    return bpe.encode_decode(docs, BYTE_BPE)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: A trained network, sketches and a tokenizer are beyond SQL; see the tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
