"""Results and histories as files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_result(
    frames: Mapping[str, DataFrame], folder: str, partition_by: Sequence[str] = ()
) -> None:
    """Write each frame as JSON lines under its name, keeping NULL fields.

    Numbers that JSON lacks (NaN, Infinity) are refused rather than written. With
    ``partition_by`` only the partitions that the frames hold are replaced, so the
    results of other runs stay.
    """
    for name, df in frames.items():
        doubles = [c for c, kind in df.dtypes if kind in ("double", "float") and c not in partition_by]
        checked = df
        for column in doubles:
            value = F.col(f"`{column}`")
            finite = ~(F.isnan(value) | (F.abs(value) == float("inf")))
            refused = F.raise_error(F.lit(f"{name}.{column}: not a finite number"))
            checked = checked.withColumn(
                column, F.when(value.isNull() | finite, value).otherwise(refused.cast("double"))
            )
        writer = checked.write.mode("overwrite").option("ignoreNullFields", "false")
        if partition_by:
            writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
        writer.json(f"{folder}/{name}")


def write_documents(df: DataFrame, folder: str) -> None:
    """Write each row as a JSON document in a file of its own, by all tasks.

    A small table is one split, so rows are dealt first. Tasks move their own files
    into the folder, else the driver would, one by one. On a local disk each file
    created starts a process that sets its mode; a checksum beside it would be another.
    """
    writer = df.repartition(df.sparkSession.sparkContext.defaultParallelism).write
    writer = writer.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    local = "org.apache.hadoop.fs.RawLocalFileSystem"
    writer.option("fs.file.impl", local).option("fs.file.impl.disable.cache", "true").json(folder)


def append_history(df: DataFrame, table: str, batch_id: int) -> None:
    """Append one batch of log rows. Repeating a batch replaces it, so a retried
    write never doubles rows."""
    df.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
