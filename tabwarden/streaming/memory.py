"""State kept between micro-batches as an append-only table.

Each batch writes its own partition, and reads only those of earlier batches. A
batch that is tried again reads what it read before and replaces what it wrote,
so results do not depend on failures. Rows of one key are combined before they
are shuffled, which keyed operator state cannot do: a key that fills a third of a
batch costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BatchTable:
    spark: SparkSession
    path: str
    schema: str

    def create(self) -> BatchTable:
        """Make the table readable before its first batch."""
        empty = self.spark.createDataFrame([], self.schema)
        empty.write.mode("overwrite").parquet(f"{self.path}/batch_id=-1")
        return self

    def append(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def of(self, batch_id: int) -> DataFrame:
        """The rows of one batch; those of -1 are none."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch_id={batch_id}")

    def rows(self, before: int | None = None) -> DataFrame:
        table = self.spark.read.schema(f"{self.schema}, batch_id bigint").parquet(self.path)
        if before is not None:
            table = table.filter(F.col("batch_id") < before)
        return table.drop("batch_id")


@dataclass(frozen=True)
class KeyedTable(BatchTable):
    """A batch table with a few rows per key, of which a batch reads only what its keys
    can meet.

    Rows lie in hash buckets of their key, so that ``touching`` lists and reads only
    buckets that the batch touches. Every ``fanout`` batches, their rows are written
    again as one run of ``fanout`` times the buckets, and every ``fanout`` runs as a
    longer one: a batch opens a few runs per level, buckets stay about as large as those
    of one batch, and each row is written again once per level. Beyond ``most_buckets``
    buckets they grow. ``rows`` still reads the batches themselves, which are kept.
    """

    key: str
    fold: Callable[[DataFrame], DataFrame] | None = None
    fanout: int = 8
    buckets: int = 16
    most_buckets: int = 4096

    def __post_init__(self) -> None:
        if self.fanout < 2 or self.most_buckets % self.buckets:
            raise ValueError("runs join at least two, and most_buckets is a multiple of buckets")

    def create(self) -> KeyedTable:
        self._write(self.spark.createDataFrame([], self.schema), -1, 0)
        return self

    def rows(self, before: int | None = None) -> DataFrame:
        return super().rows(before).drop("bucket")

    def _buckets(self, level: int) -> int:
        n = self.buckets
        while level and n < self.most_buckets and self.most_buckets % (n * self.fanout) == 0:
            n, level = n * self.fanout, level - 1
        return n

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def _run(self, first: int, level: int) -> str:
        return f"{self.path}-runs/{first}-{first + self.fanout**level}" if level else f"{self.path}/batch_id={first}"

    def _written(self, path: str) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def _write(self, df: DataFrame, first: int, level: int) -> None:
        bucketed = df.withColumn("bucket", self._bucket(self._buckets(level))).repartition("bucket")
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(self._run(first, level))

    def append(self, df: DataFrame, batch_id: int) -> None:
        self._write(df, batch_id, 0)

    def _cover(self, first: int, level: int) -> list[tuple[str, int]]:
        """The runs that hold the batches from ``first`` on, as long ones as there are."""
        run = self._run(first, level)
        if self._written(run):
            return [(run, level)]
        if not level:
            return []
        step = self.fanout ** (level - 1)
        return [found for k in range(self.fanout) for found in self._cover(first + k * step, level - 1)]

    def _runs(self, before: int) -> list[tuple[str, int]]:
        level = 0
        while self.fanout ** (level + 1) <= before:
            level += 1
        first, found = 0, []
        while first < before:
            while first + self.fanout**level > before:
                level -= 1
            found += self._cover(first, level)
            first += self.fanout**level
        return found

    def _read(self, runs: list[tuple[str, int]], touched: list[int] | None = None) -> DataFrame:
        """Rows of runs, in all buckets or those that the buckets of the finest kind lie in."""
        rows = None
        for level in sorted({level for _, level in runs}):
            n = self._buckets(level)
            for path in (path for path, at in runs if at == level):
                run = self.spark.read.schema(f"{self.schema}, bucket int").parquet(path)
                inside = n if touched is None else {b % n for b in touched}
                if touched is not None and len(inside) < n:
                    run = run.filter(F.col("bucket").isin(sorted(inside)))
                rows = run if rows is None else rows.unionByName(run)
        return self.spark.createDataFrame([], self.schema) if rows is None else rows.drop("bucket")

    def touching(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """The rows of earlier batches in the buckets of ``keys``, which hold all rows of
        these keys. Runs that end here are joined first; a batch tried again finds them."""
        level, size = 1, self.fanout
        while batch_id and batch_id % size == 0:
            run, first = self._run(batch_id - size, level), batch_id - size
            if not self._written(run):
                parts = [found for k in range(self.fanout) for found in self._cover(first + k * size // self.fanout, level - 1)]
                rows = self._read(parts)
                self._write(self.fold(rows) if self.fold else rows, first, level)
            level, size = level + 1, size * self.fanout
        # At most ``most_buckets`` numbers reach the driver.
        touched = [r.b for r in keys.select(self._bucket(self.most_buckets).alias("b")).distinct().collect()]
        return self._read(self._runs(batch_id), touched)
