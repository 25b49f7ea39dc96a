from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabwarden.functions import hotkeys as h


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(11)
    rows = [
        (n, "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 6)}", rng.randint(-5, 5))
        for n in rng.sample(range(1000), 400)
    ]
    return spark.createDataFrame(rows, "seq bigint, key string, x int")


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("span", [1, 7, 100_000])
def test_running_values_equal_plain_windows(log, span):
    specs = {
        "total": h.Running(F.col("x")),
        "before": h.Running(F.col("x"), inclusive=False),
        "top": h.Running(F.col("x"), "max", inclusive=False),
    }
    order = Window.partitionBy("key").orderBy("seq")
    upto, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    plain = log.select(
        "seq",
        F.sum("x").over(upto).alias("total"),
        F.coalesce(F.sum("x").over(ahead), F.lit(0)).alias("before"),
        F.coalesce(F.max("x").over(ahead), F.lit(-99)).alias("top"),
    )
    found = h.running(log, ["key"], "seq", specs, span=span).withColumn("top", F.coalesce("top", F.lit(-99)))
    names = ("seq", "total", "before", "top")
    assert _rows(found, *names) == _rows(plain, *names)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("span", [1, 9, 100_000])
def test_neighbours_equal_plain_windows(log, span, forward):
    order = Window.partitionBy("key").orderBy("seq")
    step = F.lead if forward else F.lag
    plain = log.select("seq", F.coalesce(step("x").over(order), F.lit(-99)).alias("y"))
    found = h.neighbour(log, ["key"], "seq", {"y": "x"}, forward=forward, span=span)
    assert _rows(found.withColumn("y", F.coalesce("y", F.lit(-99))), "seq", "y") == _rows(plain, "seq", "y")


@pytest.mark.parametrize("hot", [1, 1000])
def test_hot_join_keeps_every_row_once(log, monkeypatch, hot):
    monkeypatch.setattr(h, "HOT_KEYS", hot)
    monkeypatch.setattr(h, "SPLIT_ROWS", 30)
    sizes = log.filter("key <> 'k0'").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    found = h.join_per_key(log, sizes, ["key"], "n", "seq")
    plain = log.join(sizes, "key", "left")
    blank = [F.coalesce(name, F.lit(-1)).alias(name) for name in ("n", "first")]
    assert _rows(found.select("seq", *blank), "seq", "n", "first") == _rows(plain.select("seq", *blank), "seq", "n", "first")


def test_null_and_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(h, "SPLIT_ROWS", 100)
    key = F.when(F.col("id") % 10 < 6, F.lit(None)).when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), F.col("id")))
    facts = spark.range(40_000).select(F.col("id").alias("seq"), key.cast("string").alias("key"))
    per_key = facts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    monkeypatch.setattr(h, "HOT_KEYS", 5)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        for null_safe, matched in (((), 16_000), (("key",), 40_000)):
            found = h.join_per_key(facts, per_key, ["key"], "n", "seq", null_safe)
            sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert sum(sizes) == 40_000
            assert max(sizes) <= 2 * 40_000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
            assert found.filter("n IS NOT NULL").count() == matched
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
