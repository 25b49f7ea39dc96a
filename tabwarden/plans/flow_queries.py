"""The whole check of one run (``flow``) and the location of drift in its inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwarden.operators import verification as x
from tabwarden.plans.check_queries import ACCOUNT_RULES, TOTALS
from tabwarden.plans.diff_queries import CELLS, SUMMARY
from tabwarden.plans.flow import flow
from tabwarden.plans.registry import query

BLOCK = 256
_COUNTS = ("before_rows", "after_rows", "added", "removed", "changed", "unchanged")
_QUALITY = ("rows", "issues", "affected_rows")


def _flow(t):
    return flow(t["accounts"], ACCOUNT_RULES, t["before_orders"], t["after_orders"], "order_id", "run")


@query(
    "flow_01_totals",
    "\nUNION ALL\n".join(
        [f"SELECT 'quality' AS part, '{n}' AS name, CAST({n} AS BIGINT) AS value FROM ({TOTALS}) AS q_{n}" for n in _QUALITY]
        + [f"SELECT 'changes', '{n}', CAST({n} AS BIGINT) FROM ({SUMMARY}) AS c_{n}" for n in _COUNTS]
        + [f"SELECT 'cells', kind, count(*) FROM ({CELLS}) AS cells GROUP BY kind"]
        + ["SELECT 'violations', engine, CAST(0 AS BIGINT) FROM (VALUES ('quality'), ('changes')) AS e (engine)"]
    ),
)
def _(t):
    """What one run counts, and what its verification found."""
    found = _flow(t)

    def long(df, part, names):
        pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("bigint").alias("value")) for n in names])
        return df.select(F.lit(part).alias("part"), F.explode(pairs).alias("x")).select("part", "x.*")

    cells = found.cells.groupBy("kind").agg(F.count(F.lit(1)).alias("value"))
    broken = found.checks.groupBy("engine").agg(F.sum("violations").alias("value"))
    return (
        long(found.quality_summary, "quality", _QUALITY)
        .unionByName(long(found.change_summary, "changes", _COUNTS))
        .unionByName(cells.select(F.lit("cells").alias("part"), F.col("kind").alias("name"), "value"))
        .unionByName(broken.select(F.lit("violations").alias("part"), F.col("engine").alias("name"), "value"))
    )


_FIELDS = "record_no, trim(order_id) AS order_id, customer, placed, status, total"
_SIDES = f"""SELECT record_no // {BLOCK} AS node, side, order_id, customer, placed, status, total, record_no FROM (
  SELECT 'b' AS side, {_FIELDS} FROM before_orders UNION ALL SELECT 'a', {_FIELDS} FROM after_orders) AS both_sides"""


@query(
    "ver_02_block_drift",
    f"""SELECT CAST(node AS BIGINT) AS node, count(*) FILTER (side = 'b') AS rows_before, count(*) FILTER (side = 'a') AS rows_after
FROM ({_SIDES}) AS s GROUP BY node HAVING node IN (
  SELECT node FROM ({_SIDES}) AS d GROUP BY node, record_no, order_id, customer, placed, status, total
  HAVING count(*) FILTER (side = 'b') <> count(*) FILTER (side = 'a'))""",
)
def _(t):
    """Blocks of 256 record numbers in which the two snapshots' shared fields differ."""
    trees = []
    for name in ("before_orders", "after_orders"):
        fields = t[name].select("record_no", F.trim("order_id").alias("order_id"), "customer", "placed", "status", "total")
        trees.append(x.fingerprint_tree(x.block_fingerprints(fields, F.floor(F.col("record_no") / BLOCK))))
    return x.drifted_nodes(*trees).filter("level = 0").select("node", "rows_before", "rows_after")
