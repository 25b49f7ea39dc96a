"""The query list: each entry pairs a Spark plan with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[["Tables"], DataFrame]


class Tables:
    """The given tables of one folder, and tables derived from them, by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def __getitem__(self, name: str) -> DataFrame:
        from tabwarden.plans import derived

        if name not in derived.TEXTS:
            return self.base(name)
        return derived.spark_frame(self, name)


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a plan. ``sql`` may name derived tables; their definitions are
    put in front of it."""

    def add(run: Run) -> Run:
        from tabwarden.plans import derived

        QUERIES[name] = Query(name, run, derived.with_definitions(sql) if sql else None)
        return run

    return add
