"""Files as rows: submissions in a folder, their bytes and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Size limits of a submission document and of a source file.
MAX_DOCUMENT_BYTES = 64 * 1024
MAX_SOURCE_BYTES = 10 * 1024 * 1024


def inbox_scan(
    spark: SparkSession, folder: str, suffix: str = ".json", max_bytes: int = MAX_DOCUMENT_BYTES
) -> DataFrame:
    """The documents directly in ``folder``, in name order.

    A document of more than ``max_bytes`` is listed without text and hash, and its
    bytes are never read, so one bad file never stops the others.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", "false")
        .load(folder)
    )
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")

    def listed(some: DataFrame, raw_hash: Column, content: Column, fits: bool) -> DataFrame:
        return some.select(
            "path", name, "length", raw_hash.alias("raw_hash"), content.alias("content"), F.lit(fits).alias("fits")
        )

    # The scan itself skips files by their length.
    small = listed(files.filter(F.col("length") <= max_bytes), hash_of(F.col("content")), F.col("content"), True)
    large = listed(
        files.filter(F.col("length") > max_bytes), F.lit(None).cast("string"), F.lit(None).cast("binary"), False
    )
    return small.unionByName(large).orderBy("file_name")


def hash_of(content: Column) -> Column:
    return F.sha2(content, 256)


def content_hash(files: DataFrame) -> DataFrame:
    """SHA-256 of the raw bytes of every file."""
    return files.select("path", "length", hash_of(F.col("content")).alias("sha256"))


def source_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Path and length of every file under ``folder``; no bytes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length")
