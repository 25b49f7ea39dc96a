"""Rule checks (VAL) over the whole ``customer`` and ``documents`` tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwarden.functions.text import display_value, strip
from tabwarden.operators import catalogs as k
from tabwarden.operators import validation as v
from tabwarden.plans.registry import query

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")

ACCOUNT_RULES = {
    "version": 1,
    "columns": {
        "account_id": {"required": True, "unique": True},
        "phone": {"required": True},
        "email": {"required": True, "type": "email"},
        "balance": {"type": "number", "min": 0, "max": 9000},
        "region_code": {"type": "integer", "max": 20},
        "segment": {"allowed": list(SEGMENTS)},
        "joined": {"type": "date"},
    },
}

_LISTED = ", ".join(f"'{name}'" for name in SEGMENTS)
_NUMBER = r"regexp_full_match(trim(balance), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')"
_INTEGER = "regexp_full_match(trim(region_code), '[+-]?[0-9]+')"
_EMAIL = r"regexp_full_match(trim(email), '[^@\s]+@[^@\s]+\.[^@\s]+')"
_DATE = (
    "(regexp_full_match(trim(joined), '[0-9]{4}-[0-9]{2}-[0-9]{2}') "
    "AND TRY_CAST(trim(joined) AS DATE) IS NOT NULL)"
)


def _sql(column: str, code: str, message: str, condition: str, extra: str = "") -> str:
    return f"""SELECT record_no AS "row", '{column}' AS "column", '{code}' AS code,
  {message} AS message, {column} AS value{extra} FROM accounts WHERE {condition}"""


REQUIRED_ID = _sql("account_id", "required", "'A nonblank value is required.'", "trim(account_id) = ''")
INTEGER = _sql(
    "region_code", "type", "'Expected a valid integer value.'",
    f"trim(region_code) <> '' AND NOT {_INTEGER}",
)
NUMBER = _sql(
    "balance", "type", "'Expected a valid number value.'", f"trim(balance) <> '' AND NOT {_NUMBER}"
)
EMAIL = _sql("email", "type", "'Expected a valid email value.'", f"trim(email) <> '' AND NOT {_EMAIL}")
DATE = _sql("joined", "type", "'Expected a valid date value.'", f"trim(joined) <> '' AND NOT {_DATE}")
MIN = _sql(
    "balance", "min", "'Value must be at least 0.'",
    f"CASE WHEN {_NUMBER} THEN CAST(trim(balance) AS DOUBLE) < 0 ELSE false END",
)
MAX = _sql(
    "balance", "max", "'Value must be at most 9000.'",
    f"CASE WHEN {_NUMBER} THEN CAST(trim(balance) AS DOUBLE) > 9000 ELSE false END",
)
MAX_REGION = _sql(
    "region_code", "max", "'Value must be at most 20.'",
    f"CASE WHEN {_INTEGER} THEN CAST(trim(region_code) AS BIGINT) > 20 ELSE false END",
)
ALLOWED = _sql(
    "segment", "allowed", "'Value is not in the configured allowed list.'",
    f"trim(segment) <> '' AND trim(segment) NOT IN ({_LISTED})",
)
UNIQUE = """SELECT record_no AS "row", 'account_id' AS "column", 'duplicate' AS code,
  concat('Duplicate value; first seen at record ', CAST(first_record AS VARCHAR), '.') AS message,
  account_id AS value
FROM (SELECT *, min(record_no) OVER (PARTITION BY trim(account_id)) AS first_record
      FROM accounts WHERE trim(account_id) <> '') AS seen
WHERE record_no > first_record"""
MISSING = """SELECT CAST(NULL AS BIGINT) AS "row", 'phone' AS "column", 'missing_column' AS code,
  'Configured column is missing from the CSV header.' AS message, '' AS value"""
REQUIRED_EMAIL = _sql("email", "required", "'A nonblank value is required.'", "trim(email) = ''")

_ALL = [
    (MISSING, 1, 0), (REQUIRED_ID, 0, 1), (UNIQUE, 0, 6), (REQUIRED_EMAIL, 2, 1), (EMAIL, 2, 2),
    (NUMBER, 3, 2), (MIN, 3, 3), (MAX, 3, 4), (INTEGER, 4, 2), (MAX_REGION, 4, 4),
    (ALLOWED, 5, 5), (DATE, 6, 2),
]
EVERY = "\nUNION ALL\n".join(
    f"SELECT *, {column} AS col_idx, {code} AS code_idx FROM ({sql}) AS part{place}"
    for place, (sql, column, code) in enumerate(_ALL)
)
RANKED = f"""SELECT CAST(row_number() OVER (ORDER BY "row" NULLS FIRST, col_idx, code_idx) AS BIGINT) AS seq,
  "row", "column", code, message, value FROM ({EVERY}) AS every_finding"""
TOTALS = f"""SELECT (SELECT count(*) FROM accounts) AS rows, count(*) AS issues,
  count(DISTINCT "row") AS affected_rows, least(count(*), 500) AS reported_findings
FROM ({EVERY}) AS every_finding"""


# Each customer is a dataset: the priorities of closed orders are the columns its rules
# name, those of open orders its header.
_RULED = "SELECT DISTINCT o_custkey AS dataset, o_orderpriority AS name FROM orders WHERE o_orderstatus <> 'O'"
_HEADED = "SELECT DISTINCT o_custkey AS dataset, o_orderpriority AS name FROM orders WHERE o_orderstatus = 'O'"


def header_catalogs(t):
    rows = t["orders"].select(F.col("o_custkey").alias("dataset"), F.col("o_orderpriority").alias("column"), "o_orderstatus")
    is_open = F.col("o_orderstatus") == "O"
    return rows.filter(~is_open).drop("o_orderstatus"), rows.filter(is_open).drop("o_orderstatus")


@query(
    "val_01_missing_column",
    f"""SELECT r.dataset, CAST(NULL AS BIGINT) AS "row", r.name AS "column", 'missing_column' AS code,
  'Configured column is missing from the CSV header.' AS message, '' AS value
FROM ({_RULED}) AS r LEFT JOIN ({_HEADED}) AS h ON h.dataset = r.dataset AND h.name = r.name WHERE h.dataset IS NULL""",
)
def _(t):
    """Rule catalogs of all datasets against their headers."""
    return k.missing_columns(*header_catalogs(t))


@query(
    "val_01_header_coverage",
    f"""SELECT dataset, count(*) AS configured, count(*) FILTER (NOT present) AS missing, bool_and(present) AS complete
FROM (SELECT r.dataset, EXISTS (SELECT 1 FROM ({_HEADED}) AS h WHERE h.dataset = r.dataset AND h.name = r.name) AS present
  FROM ({_RULED}) AS r) AS marked GROUP BY dataset""",
)
def _(t):
    """Which datasets have every column their rules name."""
    return k.header_coverage(*header_catalogs(t))


@query("val_02_required", REQUIRED_ID)
def _(t):
    return v.required(t["accounts"], "account_id")


_OPTIONAL = "\nUNION ALL\n".join(
    sql.replace("FROM accounts", "FROM blanked_accounts")
    for sql in (UNIQUE, EMAIL, NUMBER, MIN, MAX, INTEGER, MAX_REGION, ALLOWED, DATE)
)


@query(
    "val_03_blank_skip",
    f"""SELECT "column", code, count(*) AS findings, count(*) FILTER (trim(value) = '') AS findings_on_blanks
FROM ({_OPTIONAL}) AS found GROUP BY "column", code""",
)
def _(t):
    """Accounts with blanks in every column, under every check that skips blanks."""
    columns = {
        name: {check: value for check, value in rule.items() if check != "required"}
        for name, rule in ACCOUNT_RULES["columns"].items()
        if name != "phone"
    }
    found = v.all_findings(t["blanked_accounts"], {"version": 1, "columns": columns})
    return found.groupBy("column", "code").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.trim("value") == "").alias("findings_on_blanks")
    )


@query("val_04_type_integer", INTEGER)
def _(t):
    return v.type_check(t["accounts"], "region_code", "integer")


@query("val_05_type_number", NUMBER)
def _(t):
    return v.type_check(t["accounts"], "balance", "number")


@query("val_06_type_email", EMAIL)
def _(t):
    return v.type_check(t["accounts"], "email", "email")


@query("val_07_type_date", DATE)
def _(t):
    return v.type_check(t["accounts"], "joined", "date")


@query(
    "val_08_type_string",
    """SELECT 'text' AS "column", count(*) AS cells, CAST(0 AS BIGINT) AS findings FROM texts""",
)
def _(t):
    """The default type accepts all text: every document, no finding."""
    texts = t["texts"]
    summary = v.validation_summary(texts, {"version": 1, "columns": {"text": {"type": "string"}}})
    return summary.select(
        F.lit("text").alias("column"), F.col("rows").alias("cells"), F.col("issues").alias("findings")
    )


@query("val_09_min_bound", MIN)
def _(t):
    return v.min_bound(t["accounts"], "balance", 0)


@query("val_10_max_bound", MAX)
def _(t):
    return v.max_bound(t["accounts"], "balance", 9000)


@query("val_11_allowed", ALLOWED)
def _(t):
    return v.allowed(t["accounts"], "segment", SEGMENTS)


@query(
    "val_11_allowed_table",
    """SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS "row", 'order_id' AS "column", 'allowed' AS code,
  'Value is not in the configured allowed list.' AS message, CAST(l_orderkey AS VARCHAR) AS value
FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW')""",
)
def _(t):
    """Order lines whose order is not in a list that grows with the orders."""
    number = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint")
    lines = t["lineitem"].select(number.alias("record_no"), F.col("l_orderkey").cast("string").alias("order_id"))
    orders = t["orders"].filter("o_orderpriority <> '5-LOW'").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(" ")))
    return v.allowed_in(lines, "order_id", orders)


@query("val_12_unique", UNIQUE)
def _(t):
    return v.unique(t["accounts"], "account_id")


@query(
    "val_12_unique_texts",
    """SELECT record_no AS "row", 'text' AS "column", 'duplicate' AS code,
  concat('Duplicate value; first seen at record ', CAST(first_record AS VARCHAR), '.') AS message,
  text AS value
FROM (SELECT *, min(record_no) OVER (PARTITION BY trim(text, ' ' || chr(9) || chr(10) || chr(13)))
        AS first_record FROM texts) AS seen
WHERE record_no > first_record""",
)
def _(t):
    """Repeated whole documents."""
    return v.unique(t["texts"], "text")


@query("val_13_findings", f'SELECT "row", "column", code, message, value FROM ({EVERY}) AS every_finding')
def _(t):
    return v.all_findings(t["accounts"], ACCOUNT_RULES).select(*v.FINDING_COLUMNS)


@query("val_14_findings_cap", f"SELECT * FROM ({RANKED}) AS ranked WHERE seq <= 500")
def _(t):
    return v.validate(t["accounts"], ACCOUNT_RULES, max_findings=500).findings


@query("val_15_validation_summary", TOTALS)
def _(t):
    return v.validate(t["accounts"], ACCOUNT_RULES).summary.drop("status")


@query(
    "val_16_validation_status",
    f"""SELECT 'all columns' AS ruleset, CASE WHEN issues > 0 THEN 'fail' ELSE 'pass' END AS status
FROM ({TOTALS}) AS totals
UNION ALL SELECT 'segment' AS ruleset,
  CASE WHEN count(*) FILTER (trim(segment) = '') > 0 THEN 'fail' ELSE 'pass' END AS status
FROM accounts""",
)
def _(t):
    accounts = t["accounts"]
    only = {"version": 1, "columns": {"segment": {"required": True}}}
    frames = [
        v.validation_summary(accounts, rules).select(F.lit(name).alias("ruleset"), "status")
        for name, rules in (("all columns", ACCOUNT_RULES), ("segment", only))
    ]
    return frames[0].unionByName(frames[1])


@query(
    "val_17_display_value",
    """SELECT record_no, CASE WHEN text IS NULL THEN 'Not present' WHEN text = '' THEN 'Empty value'
  WHEN length(text) > 240 THEN left(text, 240) ELSE text END AS shown,
  coalesce(length(text) > 240, false) AS truncated FROM texts""",
)
def _(t):
    return t["texts"].select("record_no", display_value(F.col("text")).alias("d")).select(
        "record_no", "d.shown", "d.truncated"
    )


@query(
    "val_18_cap_notice",
    f"""SELECT issues, reported_findings, issues - reported_findings AS omitted,
  CASE WHEN issues > reported_findings THEN concat('Showing ', format('{{:,}}', reported_findings),
    ' of ', format('{{:,}}', issues), ' findings.') ELSE '' END AS notice
FROM ({TOTALS}) AS totals""",
)
def _(t):
    summary = v.validation_summary(t["accounts"], ACCOUNT_RULES, max_findings=500)
    return v.cap_notice(summary).select("issues", "reported_findings", "omitted", "notice")


LINE_RULES = {
    "version": 1,
    "columns": {
        "line_id": {"required": True, "unique": True},
        "quantity": {"required": True, "type": "number", "min": 1, "max": 48},
        "price": {"required": True, "type": "number", "min": 1000},
        "discount": {"type": "number", "min": 0, "max": 0.05},
        "flag": {"required": True, "allowed": ["A", "N"]},
        "state": {"required": True, "allowed": ["O", "F"]},
        "shipped": {"required": True, "type": "date"},
    },
}
_LINE_ISSUES = """CASE WHEN CAST(quantity AS DOUBLE) > 48 THEN 1 ELSE 0 END + CASE WHEN CAST(price AS DOUBLE) < 1000 THEN 1 ELSE 0 END
  + CASE WHEN CAST(discount AS DOUBLE) > 0.05 THEN 1 ELSE 0 END + CASE WHEN flag = 'R' THEN 1 ELSE 0 END"""


@query(
    "val_lines",
    f"""SELECT count(*) AS rows, CAST(sum({_LINE_ISSUES}) AS BIGINT) + count(*) - count(DISTINCT line_id) AS issues
FROM line_cells""",
)
def _(t):
    """All order lines against seven rules, one of them unique."""
    lines = t["line_cells"].select(F.monotonically_increasing_id().alias("record_no"), "*")
    return v.validation_summary(lines, LINE_RULES).select("rows", "issues")


@query(
    "scalar_contract",
    """SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS stripped, lower(source) AS lowered, upper(lang) AS uppered,
  contains(text, source) AS found, replace(source, 'src', '/') AS replaced, substring(text, 3, 7) AS part,
  sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS characters,
  format('{:,}', n_chars) AS grouped, list_sort(string_split(source, 'r'))[1] AS first_piece,
  CAST(least(60, CAST(pow(2, greatest(0, least(10, doc_id % 12 - 1))) AS BIGINT)) AS BIGINT) AS delay
FROM documents""",
)
def _(t):
    """The scalar functions the operators are built from, over whole documents."""
    text, source = F.col("text"), F.col("source")
    doublings = F.greatest(F.lit(0), F.least(F.lit(10), F.col("doc_id") % 12 - 1))
    return t["documents"].select(
        "doc_id",
        strip(text).alias("stripped"),
        F.lower(source).alias("lowered"),
        F.upper("lang").alias("uppered"),
        F.contains(text, source).alias("found"),
        F.replace(source, F.lit("src"), F.lit("/")).alias("replaced"),
        F.substring(text, 3, 7).alias("part"),
        F.sha2(text, 256).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"),
        F.length(text).cast("bigint").alias("characters"),
        F.format_number("n_chars", 0).alias("grouped"),
        F.array_sort(F.split(source, "r"))[0].alias("first_piece"),
        F.least(F.lit(60), F.pow(F.lit(2), doublings)).cast("bigint").alias("delay"),
    )
