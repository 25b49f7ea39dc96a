"""Snapshot comparison (CMP) over two relabelled snapshots of ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwarden.operators import catalogs as k
from tabwarden.operators import comparison as c
from tabwarden.plans.check_queries import header_catalogs
from tabwarden.plans.registry import query

SHARED = ("customer", "placed", "status", "total")

JOINED = """SELECT coalesce(trim(b.order_id), trim(a.order_id)) AS key,
    b.order_id AS b_key, a.order_id AS a_key,
    b.customer AS b_customer, a.customer AS a_customer, b.placed AS b_placed, a.placed AS a_placed,
    b.status AS b_status, a.status AS a_status, b.total AS b_total, a.total AS a_total,
    b.priority, a.warehouse
  FROM before_orders AS b FULL OUTER JOIN after_orders AS a ON trim(b.order_id) = trim(a.order_id)"""
_CHANGED = " OR ".join(f"b_{f} IS DISTINCT FROM a_{f}" for f in SHARED)
KINDED = f"""SELECT *, CASE WHEN b_key IS NULL THEN 'added' WHEN a_key IS NULL THEN 'removed'
  WHEN {_CHANGED} THEN 'changed' ELSE 'unchanged' END AS kind FROM ({JOINED}) AS joined"""
_NAMES = ", ".join(f"CASE WHEN b_{f} IS DISTINCT FROM a_{f} THEN '{f}' END" for f in SHARED)
FIELDS = f"""CASE kind WHEN 'added' THEN 'customer|placed|status|total|warehouse'
  WHEN 'removed' THEN 'customer|placed|priority|status|total' ELSE concat_ws('|', {_NAMES}) END"""
SUMMARY = f"""SELECT count(b_key) AS before_rows, count(a_key) AS after_rows,
  count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed,
  count(*) FILTER (kind = 'changed') AS changed, count(*) FILTER (kind = 'unchanged') AS unchanged,
  count(*) FILTER (kind <> 'unchanged') AS total_changes,
  least(count(*) FILTER (kind <> 'unchanged'), 500) AS reported_findings
FROM ({KINDED}) AS kinded"""
CELLS = "\nUNION ALL\n".join(
    f"""SELECT key, kind, '{f}' AS field, {b} AS before, {a} AS after FROM ({KINDED}) AS k_{f}
WHERE {about}"""
    for f, b, a, about in [
        *[
            (f, f"b_{f}", f"a_{f}",
             f"kind IN ('added', 'removed') OR (kind = 'changed' AND b_{f} IS DISTINCT FROM a_{f})")
            for f in SHARED
        ],
        ("priority", "priority", "CAST(NULL AS VARCHAR)", "kind = 'removed'"),
        ("warehouse", "CAST(NULL AS VARCHAR)", "warehouse", "kind = 'added'"),
    ]
)


def _pair(t):
    return t["before_orders"], t["after_orders"]


def _joined_names(df):
    return df.withColumn("fields", F.array_join("fields", "|"))


# Each customer is a comparison: the priorities of closed orders are the columns before,
# those of open orders the columns after, the highest of all priorities is the key.
_OLD, _NEW = (
    f"SELECT DISTINCT o_custkey AS dataset, o_orderpriority AS name FROM orders WHERE o_orderstatus {test} 'O'"
    for test in ("<>", "=")
)
_KEYS = """SELECT o_custkey AS dataset, CASE WHEN o_custkey % 7 = 0 THEN ' ' ELSE max(o_orderpriority) END AS "key"
  FROM orders GROUP BY o_custkey"""


@query(
    "cmp_01_key_missing",
    "\nUNION ALL\n".join(
        [
            f"SELECT dataset, \"key\", '' AS side, 'blank_key' AS problem FROM ({_KEYS}) AS k WHERE trim(\"key\") = ''",
            *[
                f"""SELECT dataset, "key", '{side}' AS side, 'missing_key' AS problem FROM ({_KEYS}) AS k_{side}
WHERE trim("key") <> '' AND (dataset, "key") NOT IN (SELECT (dataset, name) FROM ({names}) AS h_{side})"""
                for side, names in (("before", _OLD), ("after", _NEW))
            ],
        ]
    ),
)
def _(t):
    """The keys of all comparisons against the headers of both sides."""
    largest = F.max("o_orderpriority")
    named = t["orders"].groupBy(F.col("o_custkey").alias("dataset")).agg(largest.alias("key"))
    keys = named.withColumn("key", F.when(F.col("dataset") % 7 == 0, F.lit(" ")).otherwise(F.col("key")))
    return k.key_contracts(keys, *header_catalogs(t))


@query(
    "cmp_02_key_blank",
    """SELECT 'before' AS side, count(*) FILTER (trim(account_id) = '') AS violations,
  min(record_no) FILTER (trim(account_id) = '') AS first_record FROM accounts
UNION ALL SELECT 'after' AS side, CAST(0 AS BIGINT) AS violations, CAST(NULL AS BIGINT) AS first_record""",
)
def _(t):
    after = t["after_orders"].withColumnRenamed("order_id", "account_id")
    return c.key_blank(t["accounts"], after, "account_id")


@query(
    "cmp_03_key_duplicate",
    """SELECT side, count(*) FILTER (n = 2) AS violations, min(record_no) FILTER (n = 2) AS first_record
FROM (SELECT 'before' AS side, record_no, row_number() OVER (PARTITION BY trim(item_key) ORDER BY record_no) AS n
      FROM keyed_lines WHERE trim(item_key) <> ''
      UNION ALL SELECT 'after' AS side, record_no,
        row_number() OVER (PARTITION BY trim(text, ' ' || chr(9) || chr(10) || chr(13)) ORDER BY record_no) AS n
      FROM texts) AS numbered
GROUP BY side""",
)
def _(t):
    """Repeated part names on one side, repeated whole documents on the other."""
    return c.key_duplicate(
        t["keyed_lines"], t["texts"].withColumnRenamed("text", "item_key"), "item_key"
    )


@query(
    "cmp_04_schema_diff",
    f"""SELECT coalesce(b.dataset, a.dataset) AS dataset, coalesce(b.name, a.name) AS "column",
  CASE WHEN b.dataset IS NULL THEN 'added' ELSE 'removed' END AS change
FROM ({_OLD}) AS b FULL OUTER JOIN ({_NEW}) AS a ON a.dataset = b.dataset AND a.name = b.name
WHERE a.dataset IS NULL OR b.dataset IS NULL""",
)
def _(t):
    """Columns that only one snapshot of a customer has."""
    return c.schema_diff_catalog(*header_catalogs(t))


@query(
    "cmp_04_schema_diff_catalog",
    """SELECT coalesce(b.dataset, a.dataset) AS dataset, coalesce(b."column", a."column") AS "column",
  CASE WHEN b.dataset IS NULL THEN 'added' ELSE 'removed' END AS change
FROM (SELECT DISTINCT p_brand AS dataset, p_type AS "column" FROM part WHERE p_size <= 20) AS b
FULL OUTER JOIN (SELECT DISTINCT p_brand AS dataset, p_type AS "column" FROM part WHERE p_size > 20) AS a
  ON b.dataset = a.dataset AND b."column" = a."column"
WHERE b.dataset IS NULL OR a.dataset IS NULL
UNION ALL SELECT DISTINCT 'names' AS dataset, p_name AS "column", 'added' AS change FROM part""",
)
def _(t):
    """Catalogs of many datasets: brands with the types of their small and large parts."""
    part = t["part"]
    rows = part.select(F.col("p_brand").alias("dataset"), F.col("p_type").alias("column"), "p_size")
    names = part.select(F.lit("names").alias("dataset"), F.col("p_name").alias("column"))
    before = rows.filter("p_size <= 20").select("dataset", "column")
    after = rows.filter("p_size > 20").select("dataset", "column").unionByName(names)
    return c.schema_diff_catalog(before, after)


@query("cmp_05_diff_classify", f"SELECT key, kind FROM ({KINDED}) AS kinded")
def _(t):
    return c.diff_classify(*_pair(t), "order_id")


@query(
    "cmp_06_changed_fields",
    f"SELECT key, {FIELDS} AS fields FROM ({KINDED}) AS kinded WHERE kind = 'changed'",
)
def _(t):
    return _joined_names(c.changed_fields(*_pair(t), "order_id"))


@query(
    "cmp_07_added_rows",
    f"""SELECT key, {FIELDS} AS fields, a_customer AS customer, a_status AS status, a_total AS total,
  a_placed AS placed, warehouse FROM ({KINDED}) AS kinded WHERE kind = 'added'""",
)
def _(t):
    return _joined_names(c.added_rows(*_pair(t), "order_id"))


@query(
    "cmp_08_removed_rows",
    f"""SELECT key, {FIELDS} AS fields, b_customer AS customer, b_status AS status, b_total AS total,
  b_placed AS placed, priority FROM ({KINDED}) AS kinded WHERE kind = 'removed'""",
)
def _(t):
    return _joined_names(c.removed_rows(*_pair(t), "order_id"))


@query("cmp_09_unchanged_rows", f"SELECT key FROM ({KINDED}) AS kinded WHERE kind = 'unchanged'")
def _(t):
    return c.unchanged_rows(*_pair(t), "order_id")


def _image_text(column):
    entries = F.transform(
        F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.coalesce(F.array_join(entries, "|"), F.lit(""))


@query(
    "cmp_10_row_images",
    f"""SELECT kind, key, {FIELDS} AS fields,
  CASE WHEN b_key IS NULL THEN '' ELSE concat('customer=', b_customer, '|order_id=', b_key, '|placed=',
    b_placed, '|priority=', priority, '|status=', b_status, '|total=', b_total) END AS before,
  CASE WHEN a_key IS NULL THEN '' ELSE concat('customer=', a_customer, '|order_id=', a_key, '|placed=',
    a_placed, '|status=', a_status, '|total=', a_total, '|warehouse=', warehouse) END AS after
FROM ({KINDED}) AS kinded WHERE kind <> 'unchanged'""",
)
def _(t):
    images = _joined_names(c.row_images(*_pair(t), "order_id"))
    return images.withColumn("before", _image_text(F.col("before"))).withColumn(
        "after", _image_text(F.col("after"))
    )


@query(
    "cmp_11_diff_findings",
    f"""SELECT kind, key, {FIELDS} AS fields FROM ({KINDED}) AS kinded WHERE kind <> 'unchanged'
ORDER BY key LIMIT 500""",
)
def _(t):
    """The capped report: its limit is the feature."""
    findings = c.diff_findings(*_pair(t), "order_id", max_findings=500)
    return _joined_names(findings).select("kind", "key", "fields")


@query("cmp_12_diff_summary", SUMMARY)
def _(t):
    return c.diff_summary(*_pair(t), "order_id")


@query(
    "cmp_13_diff_status",
    f"""SELECT 'snapshots' AS pair, CASE WHEN total_changes > 0 THEN 'changed' ELSE 'unchanged' END AS status
FROM ({SUMMARY}) AS totals
UNION ALL SELECT 'self' AS pair, CASE WHEN count(*) >= 0 THEN 'unchanged' END AS status FROM before_orders
UNION ALL SELECT 'columns' AS pair, CASE WHEN count(*) >= 0 THEN 'changed' END AS status FROM before_orders""",
)
def _(t):
    before, after = _pair(t)
    wider = before.withColumn("note", F.lit(""))
    frames = []
    for name, old, new in (
        ("snapshots", before, after), ("self", before, before), ("columns", before, wider)
    ):
        summary = c.diff_summary(old, new, "order_id")
        changes = len(set(old.columns) ^ set(new.columns))
        frames.append(c.diff_status(summary, changes).select(F.lit(name).alias("pair"), "status"))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("cmp_14_cell_changes", CELLS)
def _(t):
    return c.cell_changes(*_pair(t), "order_id")


@query(
    "cmp_15_key_trim_match",
    """SELECT count(*) AS matched, count(*) FILTER (b.order_id <> a.order_id) AS spelled_differently
FROM before_orders AS b JOIN after_orders AS a ON trim(b.order_id) = trim(a.order_id)""",
)
def _(t):
    """Keys that match although they are spelled with different whitespace."""
    before, after = _pair(t)
    images = c.diff_classify(before, after, "order_id").filter(F.col("kind").isin("changed", "unchanged"))
    exact = before.join(after, "order_id", "left_semi").agg(F.count(F.lit(1)).alias("same"))
    zero = F.lit(0).cast("bigint")
    matched = images.agg(F.count(F.lit(1)).alias("matched"))
    both = matched.select("matched", zero.alias("same")).unionByName(
        exact.select(zero.alias("matched"), "same")
    )
    return both.agg(
        F.sum("matched").alias("matched"), (F.sum("matched") - F.sum("same")).alias("spelled_differently")
    )


@query(
    "cmp_lines",
    """SELECT count(*) AS before_rows, count(*) AS after_rows, count(*) FILTER (state = 'O' AND flag = 'R') AS added,
  count(*) FILTER (state = 'O' AND flag = 'R') AS removed, count(*) FILTER (state = 'F' AND flag = 'A') AS changed,
  count(*) FILTER (NOT (state = 'O' AND flag = 'R') AND NOT (state = 'F' AND flag = 'A')) AS unchanged
FROM line_cells""",
)
def _(t):
    """All order lines against a later snapshot: returned open lines get new ids,
    accepted finished ones a new price spelling."""
    lines = t["line_cells"].drop("order_id", "line_id")
    renamed = F.when((F.col("state") == "O") & (F.col("flag") == "R"), F.concat(F.lit("n"), "full_id"))
    respelled = F.when((F.col("state") == "F") & (F.col("flag") == "A"), F.concat("price", F.lit("0")))
    later = lines.withColumn("full_id", F.coalesce(renamed, "full_id")).withColumn(
        "price", F.coalesce(respelled, "price")
    )
    summary = c.diff_summary(lines, later, "full_id")
    return summary.select("before_rows", "after_rows", "added", "removed", "changed", "unchanged")
