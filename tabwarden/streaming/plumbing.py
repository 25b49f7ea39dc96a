"""How streaming queries are started."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def triggered(writer: DataStreamWriter, checkpoint: str, every: str | None) -> DataStreamWriter:
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def to_files(df: DataFrame, out: str, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = df.writeStream.outputMode("append").format("parquet").option("path", out)
    return triggered(writer, checkpoint, every).start()


def per_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    return triggered(df.writeStream.foreachBatch(work), checkpoint, every).start()
