"""Scans and sinks (SRC, SNK) on files Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwarden.functions.dataset import SOURCE_FILE
from tabwarden.operators import validation as v
from tabwarden.plans.check_queries import ACCOUNT_RULES, EVERY, TOTALS
from tabwarden.plans.registry import query
from tabwarden.session import scratch_path
from tabwarden.sources import delimited as d
from tabwarden.sources import inbox, rule_docs, sinks

_ORDER_EXPORT = """SELECT CAST(o_orderkey AS STRING) AS order_id, o_orderstatus AS status,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE concat(' ', o_orderpriority, ', "', o_orderstatus, '" ') END AS note
FROM {orders}"""


def _export(t, df, label: str, header: bool = True) -> str:
    path = scratch_path(t.spark, label)
    writer = df.write.option("header", header).option("escape", '"').option("emptyValue", "")
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.csv(path)
    return path


@query(
    "src_01_read_export",
    """SELECT doc_id AS id, sha256(replace(text, chr(13), '')) AS text_hash, lang, source AS origin
FROM documents""",
)
def _(t):
    """Documents through a multi-line quoted export and back, text unchanged."""
    documents = t["documents"].select(
        F.col("doc_id").cast("string").alias("id"), "text", "lang", F.col("source").alias("origin")
    )
    path = _export(t, documents, "documents-export")
    ds = d.read_export(t.spark, path, multi_line=True)
    text = F.replace("text", F.lit("\r"), F.lit(""))
    return ds.select(
        F.col("id").cast("bigint").alias("id"), F.sha2(text, 256).alias("text_hash"), "lang", "origin"
    )


@query(
    "src_01_read_export_plain",
    """SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderstatus = 'P' THEN ''
  ELSE concat(' ', o_orderpriority, ', "', o_orderstatus, '" ') END AS note FROM orders""",
)
def _(t):
    """Orders with quotes, separators and outer spaces in a splittable export."""
    orders = t.spark.sql(_ORDER_EXPORT, orders=t["orders"])
    ds = d.read_export(t.spark, _export(t, orders, "orders-export"), multi_line=False)
    return ds.select(F.col("order_id").cast("bigint").alias("id"), "status", "note")


@query(
    "src_02_header_contract",
    """SELECT p_brand AS source, CASE WHEN trim(h) = '' THEN 'blank_header' ELSE 'duplicate_header' END AS code,
  h AS header
FROM (SELECT p_brand, CASE WHEN p_size = 50 THEN ' ' ELSE p_name END AS h FROM part) AS named
WHERE trim(h) = ''
UNION ALL
SELECT p_brand AS source, 'duplicate_header' AS code, h AS header
FROM (SELECT p_brand, CASE WHEN p_size = 50 THEN ' ' ELSE p_name END AS h FROM part) AS named
GROUP BY p_brand, h HAVING count(*) > 1""",
)
def _(t):
    """Part names as the headers of one file per brand."""
    headers = t["part"].select(
        F.col("p_brand").alias("source"),
        F.col("p_partkey").alias("position"),
        F.when(F.col("p_size") == 50, " ").otherwise(F.col("p_name")).alias("header"),
    )
    return d.header_contract(headers)


@query(
    "src_03_structure_quarantine",
    """SELECT count(*) FILTER (o_orderstatus <> 'P') AS good, count(*) FILTER (o_orderstatus = 'P') AS bad,
  count(DISTINCT concat(o_orderkey, ',', o_orderstatus)) FILTER (o_orderstatus = 'P') AS raw_lines
FROM orders""",
)
def _(t):
    """Pending orders are written one field short."""
    short = F.concat(F.col("o_orderkey").cast("string"), F.lit(","), F.col("o_orderstatus"))
    full = F.concat(short, F.lit(","), F.col("o_orderpriority"))
    line = F.when(F.col("o_orderstatus") == "P", short).otherwise(full)
    path = scratch_path(t.spark, "ragged-export")
    orders = t["orders"].select(line.alias("value"))
    header = t.spark.createDataFrame([("order_id,status,priority",)], "value string")
    header.coalesce(1).write.text(path)
    # Ragged rows go under their own header line, one file per task.
    orders.write.mode("append").text(path)
    scanned = d.scan_export_lines(t.spark, path, ["order_id", "status", "priority"])
    good, bad = d.structure_quarantine(scanned)
    zero = F.lit(0).cast("bigint")
    sides = good.agg(F.count(F.lit(1)).alias("good")).select("good", zero.alias("bad"), zero.alias("raw_lines"))
    wrong = bad.agg(F.count(F.lit(1)).alias("bad"), F.countDistinct("raw").alias("raw_lines"))
    both = sides.unionByName(wrong.select(zero.alias("good"), "bad", "raw_lines"))
    return both.agg(*[F.sum(n).alias(n) for n in ("good", "bad", "raw_lines")])


@query(
    "src_03_structure_checks",
    """SELECT 'blank_line' AS "check", count(*) FILTER (o_orderpriority = '5-LOW') AS violations FROM orders
UNION ALL SELECT 'stray_quote' AS "check", count(*) FILTER (o_orderpriority = '1-URGENT') AS violations FROM orders
UNION ALL SELECT 'not_utf8' AS "check", CAST(0 AS BIGINT) AS violations""",
)
def _(t):
    """Lines with stray quotes, and blank lines, that a CSV parser would accept."""
    key = F.col("o_orderkey").cast("string")
    line = (
        F.when(F.col("o_orderpriority") == "5-LOW", "")
        .when(F.col("o_orderpriority") == "1-URGENT", F.concat(key, F.lit(',"urgent"now')))
        .otherwise(F.concat(key, F.lit(',"a ""quoted"" word, and more"')))
    )
    path = scratch_path(t.spark, "quoted-export")
    t["orders"].select(line.alias("value")).write.text(path)
    checks = d.structure_checks(t.spark, path, multi_line=False)
    return checks.groupBy("check").agg(F.sum("violations").alias("violations"))


@query("src_04_record_numbers", "SELECT o_orderkey AS id, o_orderkey + 2 AS record_no FROM orders")
def _(t):
    """Numbers from the place of each row in its Parquet file."""
    orders = d.with_record_no(t.base("orders").select("o_orderkey"))
    return orders.select(F.col("o_orderkey").alias("id"), "record_no")


@query(
    "src_04_record_numbers_export",
    """SELECT count(*) AS records, count(DISTINCT o_orderkey) AS distinct_ids,
  CAST(0 AS BIGINT) AS out_of_order, CAST(0 AS BIGINT) AS not_consecutive FROM orders""",
)
def _(t):
    """Block-wise numbering of an export agrees with the order of its rows."""
    orders = t["orders"].select(F.col("o_orderkey").cast("string").alias("order_id"), "o_orderstatus")
    path = _export(t, orders.repartitionByRange(4, F.col("order_id").cast("bigint")).sortWithinPartitions(
        F.col("order_id").cast("bigint")), "numbered-export")
    ds = d.read_export(t.spark, path, multi_line=False)
    per_file = ds.groupBy(SOURCE_FILE).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("order_id").alias("ids"),
        F.min(F.col("order_id").cast("bigint") - F.col("record_no")).alias("low"),
        F.max(F.col("order_id").cast("bigint") - F.col("record_no")).alias("high"),
        F.min("record_no").alias("first"),
        F.max("record_no").alias("last"),
    )
    return per_file.agg(
        F.sum("n").alias("records"),
        F.sum("ids").alias("distinct_ids"),
        F.count_if(F.col("low") != F.col("high")).alias("out_of_order"),
        F.count_if((F.col("first") != 2) | (F.col("last") != F.col("n") + 1)).alias("not_consecutive"),
    )


@query(
    "src_05_volume_guard",
    """SELECT 'max_rows' AS "check", count(*) AS observed, CAST(100000 AS BIGINT) AS "limit",
  CAST(CASE WHEN count(*) > 100000 THEN 1 ELSE 0 END AS BIGINT) AS violations FROM lineitem
UNION ALL SELECT 'max_bytes' AS "check", CAST(max(strlen(html)) AS BIGINT) AS observed,
  CAST(10485760 AS BIGINT) AS "limit", CAST(0 AS BIGINT) AS violations FROM pages""",
)
def _(t):
    pages = t["pages"].select(F.octet_length("html").alias("length"))
    return d.volume_guard(t["lineitem"], 100_000, pages, inbox.MAX_SOURCE_BYTES)


@query(
    "src_06_rule_catalog",
    """SELECT rule_set, CAST(0 AS BIGINT) AS col_idx, concat('z ', p_name) AS "column", true AS required,
  true AS "unique", 'string' AS type, '' AS bounds, '' AS allowed FROM rule_docs WHERE shape > 20
UNION ALL SELECT rule_set, CAST(1 AS BIGINT), 'b', false, false, 'number',
  concat(CAST(shape AS VARCHAR), '..', CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR)), ''
FROM rule_docs JOIN part ON p_partkey = rule_set WHERE shape > 20
UNION ALL SELECT rule_set, CAST(2 AS BIGINT), 'a', false, false, 'string', '', concat(p_type, '|x')
FROM rule_docs WHERE shape > 20""",
)
def _(t):
    rules, _ = rule_docs.rule_catalog(t["rule_docs"].select("rule_set", "doc"))
    two_places = F.col("max").try_cast("decimal(18,2)").cast("string")
    bounds = F.when(F.col("min").isNotNull(), F.concat("min", F.lit(".."), two_places)).otherwise("")
    return rules.select(
        "rule_set",
        F.col("col_idx").cast("bigint").alias("col_idx"),
        "column",
        "required",
        "unique",
        "type",
        bounds.alias("bounds"),
        F.coalesce(F.array_join("allowed", "|"), F.lit("")).alias("allowed"),
    )


@query(
    "src_06_rule_lint",
    """SELECT rule_set, CASE WHEN shape <= 5 OR shape IN (18, 19) THEN '' WHEN shape = 6 THEN ' ' ELSE p_name END AS "column",
  CASE shape WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'not_an_object' WHEN 3 THEN 'wrong_keys'
    WHEN 4 THEN 'bad_version' WHEN 5 THEN 'columns_not_an_object' WHEN 6 THEN 'blank_column'
    WHEN 7 THEN 'rule_not_an_object' WHEN 8 THEN 'unknown_rule_key' WHEN 9 THEN 'required_not_boolean'
    WHEN 10 THEN 'unique_not_boolean' WHEN 11 THEN 'bad_type' WHEN 12 THEN 'bound_needs_number'
    WHEN 13 THEN 'bad_min' WHEN 14 THEN 'bad_max' WHEN 15 THEN 'min_exceeds_max' WHEN 16 THEN 'bad_allowed'
    WHEN 17 THEN 'bad_allowed' WHEN 18 THEN 'invalid_json' WHEN 19 THEN 'invalid_json'
    WHEN 20 THEN 'bad_type' END AS code
FROM rule_docs WHERE shape <= 20""",
)
def _(t):
    _, lint = rule_docs.rule_catalog(t["rule_docs"].select("rule_set", "doc"))
    return lint


def _inbox_folder(t) -> str:
    path = scratch_path(t.spark, "inbox")
    jobs = t["supplier"].select(
        F.lit("orders_check").alias("event_type"),
        F.concat(F.lit("data/"), F.col("s_suppkey").cast("string"), F.lit(".csv")).alias("input"),
        F.col("s_name").alias("event_id"),
    )
    sinks.write_documents(jobs, path)
    return path


_JOB = """concat('{"event_type":"orders_check","input":"data/', CAST(s_suppkey AS VARCHAR), '.csv","event_id":"', s_name,
  '"}', chr(10))"""


@query(
    "src_07_inbox_scan",
    f"SELECT sha256({_JOB}) AS raw_hash, CAST(strlen({_JOB}) AS BIGINT) AS length, true AS fits FROM supplier",
)
def _(t):
    """One submission document per supplier, one file each."""
    return inbox.inbox_scan(t.spark, _inbox_folder(t), ".json").select("raw_hash", "length", "fits")


@query("src_08_content_hash", "SELECT url AS path, CAST(strlen(html) AS BIGINT) AS length, sha256(html) AS sha256 FROM pages")
def _(t):
    pages = t["pages"].select(
        F.col("url").alias("path"),
        F.octet_length("html").cast("bigint").alias("length"),
        F.encode("html", "UTF-8").alias("content"),
    )
    return inbox.content_hash(pages)


@query(
    "snk_01_write_result",
    f"""SELECT 'findings' AS part, "column", code, count(*) AS n FROM ({EVERY}) AS every_finding
GROUP BY "column", code
UNION ALL SELECT 'summary' AS part, '' AS "column", 'fail' AS code, issues AS n FROM ({TOTALS}) AS totals""",
)
def _(t):
    """Summary and findings written as JSON by run, then read back."""
    accounts = t["accounts"]
    run = F.lit("run-1").alias("run_id")
    findings = v.all_findings(accounts, ACCOUNT_RULES)
    summary = v.validation_summary(accounts, ACCOUNT_RULES)
    folder = scratch_path(t.spark, "result")
    sinks.write_result(
        {"findings": findings.select(run, "*"), "summary": summary.select(run, "*")}, folder, ["run_id"]
    )
    read = t.spark.read
    found = read.schema(findings.schema).json(f"{folder}/findings").groupBy("column", "code")
    totals = read.schema(summary.schema).json(f"{folder}/summary")
    return found.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("findings").alias("part"), "column", "code", "n"
    ).unionByName(
        totals.select(
            F.lit("summary").alias("part"),
            F.lit("").alias("column"),
            F.col("status").alias("code"),
            F.col("issues").alias("n"),
        )
    )


@query(
    "snk_02_append_history",
    """SELECT CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS batch, event_type,
  count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2""",
)
def _(t):
    """The event log appended in two batches; the second is written twice."""
    events = t["events"].select("event_id", "event_type")
    table = scratch_path(t.spark, "history")
    first, second = events.filter("event_type <> 'error'"), events.filter("event_type = 'error'")
    for batch, rows in ((0, first), (1, second), (1, second)):
        sinks.append_history(rows, table, batch)
    stored = t.spark.read.schema("event_id bigint, event_type string, batch_id bigint").parquet(table)
    return stored.groupBy(F.col("batch_id").alias("batch"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")
    )
