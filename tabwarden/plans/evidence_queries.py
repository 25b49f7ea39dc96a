"""Evidence, briefings (EVD, BRF) and verification (VER) over runs derived from
``orders``: ten customers' orders make the export and the snapshots of one run."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwarden.operators import briefing as b
from tabwarden.operators import comparison as c
from tabwarden.operators import evidence as e
from tabwarden.operators import validation as v
from tabwarden.operators import verification as x
from tabwarden.plans.diff_queries import FIELDS, KINDED, SUMMARY
from tabwarden.plans.check_queries import ACCOUNT_RULES, TOTALS
from tabwarden.plans.registry import query
from tabwarden.session import written

RUN_RULES = {
    "version": 1,
    "columns": {"total": {"type": "number", "max": 400000}, "status": {"allowed": ["F", "O"]}},
}
BY = ["run_id"]
_SCHEMA_RUNS = "status = 'P' AND order_id LIKE 'R%' AND length(total) = 8"


def run_results(t) -> e.RunResults:
    before, after = t["run_before"], t["run_after"]
    changed = after.filter(_SCHEMA_RUNS).select("run_id").distinct()
    entries = F.array(
        *[
            F.struct(F.lit(change).alias("change"), F.lit(column).alias("column"))
            for change, column in (("added", "warehouse"), ("removed", "priority"))
        ]
    )
    return e.RunResults(
        quality=v.all_findings(before, RUN_RULES, by=BY),
        quality_summary=v.validation_summary(before, RUN_RULES, by=BY),
        changes=c.row_images(before, after, "order_id", by=BY),
        change_summary=c.diff_summary(before, after, "order_id", by=BY),
        schema=changed.select("run_id", F.explode(entries).alias("s")).select("run_id", "s.*"),
    )


QUALITY = """SELECT run_id, record_no AS "row", 'total' AS "column", 'max' AS code, 'Value must be at most 400000.' AS message,
  total AS value, 0 AS col_idx FROM run_before WHERE CAST(total AS DOUBLE) > 400000
UNION ALL SELECT run_id, record_no, 'status', 'allowed', 'Value is not in the configured allowed list.', status, 1
FROM run_before WHERE status = 'P'"""
RUN_KINDED = f"""SELECT concat('run-', CAST(CAST(coalesce(b_customer, a_customer) AS BIGINT) // 10 AS VARCHAR)) AS run_id, *
FROM ({KINDED}) AS kinded"""
SCHEMA = f"SELECT DISTINCT run_id FROM run_after WHERE {_SCHEMA_RUNS}"
_BEFORE = """CASE WHEN b_key IS NULL THEN 'null' ELSE concat('{"order_id":"', b_key, '","customer":"', b_customer,
  '","status":"', b_status, '","total":"', b_total, '","placed":"', b_placed, '","priority":"', priority, '"}') END"""
_AFTER = """CASE WHEN a_key IS NULL THEN 'null' ELSE concat('{"order_id":"', a_key, '","customer":"', a_customer,
  '","status":"', a_status, '","total":"', a_total, '","placed":"', a_placed, '","warehouse":"', warehouse, '"}') END"""
ENTRIES = f"""SELECT run_id, CAST(n AS BIGINT) AS place, concat('V', n) AS id, concat('{{"row":', "row", ',"column":"', "column",
  '","code":"', code, '","message":"', message, '","value":"', value, '","id":"V', n, '"}}') AS payload
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY "row", col_idx) AS n FROM ({QUALITY}) AS q) AS ranked
WHERE n <= 20
UNION ALL SELECT run_id, CAST(21 AS BIGINT), 'C1',
  '{{"id":"C1","kind":"schema","added":["warehouse"],"removed":["priority"]}}' FROM ({SCHEMA}) AS s
UNION ALL SELECT r.run_id, CAST(n + 21 AS BIGINT), concat('C', n + shift), concat('{{"kind":"', kind, '","key":"', key,
  '","before":', {_BEFORE}, ',"after":', {_AFTER}, ',"fields":["', replace({FIELDS}, '|', '","'), '"],"id":"C', n + shift, '"}}')
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY key) AS n FROM ({RUN_KINDED}) AS k
  WHERE kind <> 'unchanged') AS r
JOIN (SELECT a.run_id, CASE WHEN s.run_id IS NULL THEN 0 ELSE 1 END AS shift FROM (SELECT DISTINCT run_id FROM run_before) AS a
  LEFT JOIN ({SCHEMA}) AS s ON s.run_id = a.run_id) AS f ON f.run_id = r.run_id WHERE n <= 20"""
RUN_TOTALS = f"""SELECT q.run_id, q.rows, q.issues, q.affected_rows, d.added, d.removed, d.changed, d.unchanged,
  d.added + d.removed + d.changed AS total_changes, CASE WHEN s.run_id IS NULL THEN 0 ELSE 1 END AS schema_changes
FROM (SELECT a.run_id, count(*) AS rows, CAST(sum(CASE WHEN CAST(total AS DOUBLE) > 400000 THEN 1 ELSE 0 END
    + CASE WHEN status = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS issues,
  count(*) FILTER (CAST(total AS DOUBLE) > 400000 OR status = 'P') AS affected_rows FROM run_before AS a GROUP BY a.run_id) AS q
JOIN (SELECT run_id, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed,
  count(*) FILTER (kind = 'changed') AS changed, count(*) FILTER (kind = 'unchanged') AS unchanged
  FROM ({RUN_KINDED}) AS k GROUP BY run_id) AS d ON d.run_id = q.run_id
LEFT JOIN ({SCHEMA}) AS s ON s.run_id = q.run_id"""


@query("evd_01_evidence_ids", f"SELECT run_id, place, id, payload FROM ({ENTRIES}) AS entries")
def _(t):
    entries = e.evidence_ids(run_results(t))
    return entries.select("run_id", F.col("place").cast("bigint").alias("place"), "id", "payload")


@query(
    "evd_02_schema_evidence",
    f"""SELECT run_id, 'C1' AS id, '{{"id":"C1","kind":"schema","added":["warehouse"],"removed":["priority"]}}' AS payload
FROM ({SCHEMA}) AS s""".replace("{{", "{").replace("}}", "}"),
)
def _(t):
    return e.schema_evidence(run_results(t).schema).select("run_id", "id", "payload")


@query(
    "evd_03_bounded_values",
    """SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(left(text, 500), '… [truncated]') ELSE text END AS shown,
  length(text) > 500 AS trimmed, CAST(least(len(string_split(text, ' ')), 20) AS BIGINT) AS words,
  len(string_split(text, ' ')) > 20 OR list_max(list_transform(string_split(text, ' ')[1:20], lambda w: length(w))) > 500
  AS words_trimmed FROM documents""",
)
def _(t):
    """Whole texts as single values, and their words as long lists."""
    words = F.split("text", " ")
    return t["documents"].select(
        "doc_id",
        e.bounded_text(F.col("text")).alias("shown"),
        e.text_is_cut(F.col("text")).alias("trimmed"),
        F.size(e.bounded_list(words)).cast("bigint").alias("words"),
        e.list_is_cut(words).alias("words_trimmed"),
    )


# Documents inside objects of one list each, up to three deep, every other one inside
# one more list; a third of them as the list of their words.
_WORDS = "list_transform(string_split(text, ' ')[1:20], lambda w: CASE WHEN length(w) > 500 THEN concat(left(w, 500), '… [truncated]') ELSE w END)"


@query(
    "evd_03_bounded_json",
    f"""SELECT doc_id, CASE
  WHEN deep = 3 AND outer_list THEN '[{{"in":[{{"in":["[nested object omitted]"]}}]}}]'
  WHEN deep = 3 THEN '{{"in":[{{"in":[{{"in":"[nested list omitted]"}}]}}]}}'
  ELSE concat(CASE WHEN outer_list THEN '[' ELSE '' END, repeat('{{"in":[', deep),
    CASE WHEN words AND deep = 2 AND outer_list THEN '"[nested list omitted]"'
      WHEN words THEN CAST(to_json({_WORDS}) AS VARCHAR)
      ELSE CAST(to_json(CASE WHEN length(text) > 500 THEN concat(left(text, 500), '… [truncated]') ELSE text END) AS VARCHAR) END,
    repeat(']}}', deep), CASE WHEN outer_list THEN ']' ELSE '' END) END AS shown,
  deep = 3 OR (words AND (deep = 2 AND outer_list OR len(string_split(text, ' ')) > 20
    OR list_max(list_transform(string_split(text, ' ')[1:20], lambda w: length(w))) > 500))
  OR (NOT words AND length(text) > 500) AS trimmed
FROM (SELECT doc_id, coalesce(text, '') AS text, doc_id // 6 % 4 AS deep, doc_id % 2 = 1 AS outer_list, doc_id % 3 = 0 AS words
  FROM documents) AS shaped""",
)
def _(t):
    """Whole texts nested up to seven levels deep."""
    text = F.coalesce("text", F.lit(""))
    deep, outer = F.expr("CAST((doc_id div 6) % 4 AS INT)"), F.col("doc_id") % 2 == 1
    inner = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.split(text, " "))).otherwise(F.to_json(text.cast("variant")))
    nested = F.concat(
        F.when(outer, "[").otherwise(""), F.repeat(F.lit('{"in":['), deep), inner,
        F.repeat(F.lit("]}"), deep), F.when(outer, "]").otherwise(""),
    )
    documents = t["documents"].select("doc_id", nested.alias("nested"))
    return documents.select("doc_id", F.inline(F.array(e.bounded_json(F.parse_json("nested")))))


PARTS = [f"part_{place:02d}" for place in range(20)]


def document_runs(t) -> e.RunResults:
    """Runs of long entries: the documents of one source. Those not in English are
    findings, their languages are added columns, and every text, cut into twenty
    fields, is an added record."""
    source = F.col("source").alias("run_id")
    size = F.ceil(F.length("text") / 20).cast("int")
    pieces = [F.substring("text", F.lit(place) * size + 1, size).alias(name) for place, name in enumerate(PARTS)]
    documents = t["documents"].select(source, F.col("doc_id").cast("string").alias("key"), *pieces)
    names = F.array(*[F.lit(name) for name in PARTS])
    foreign = t["documents"].filter(F.col("lang") != "en")
    none, cap = F.lit(0).cast("bigint"), F.lit(500).cast("bigint")
    marked = F.count_if(F.coalesce(F.col("lang") != "en", F.lit(False)))
    totals = t["documents"].groupBy(source).agg(F.count(F.lit(1)).alias("n"), marked.alias("marked"))
    return e.RunResults(
        quality=foreign.select(
            source, F.col("doc_id").alias("row"), F.lit("text").alias("column"), F.lit("type").alias("code"),
            F.lit("Expected a valid English value.").alias("message"), F.col("text").alias("value"),
            F.lit(0).alias("col_idx"), F.lit(2).alias("code_idx"),
        ),
        quality_summary=totals.select(
            "run_id", F.col("n").alias("rows"), F.col("marked").alias("issues"), F.col("marked").alias("affected_rows"),
            F.least("marked", cap).alias("reported_findings"), F.lit("fail").alias("status"),
        ),
        changes=documents.select(
            "run_id", F.lit("added").alias("kind"), "key", F.lit(None).cast("map<string,string>").alias("before"),
            F.map_from_arrays(names, F.array(*PARTS)).alias("after"), names.alias("fields"),
        ),
        change_summary=totals.select(
            "run_id", none.alias("before_rows"), F.col("n").alias("after_rows"), F.col("n").alias("added"),
            none.alias("removed"), none.alias("changed"), none.alias("unchanged"), F.col("n").alias("total_changes"),
            F.least("n", cap).alias("reported_findings"),
        ),
        schema=foreign.select(source, F.lit("added").alias("change"), F.col("lang").alias("column")).distinct(),
    )


def _shown(text: str) -> str:
    cut = f"CASE WHEN length({text}) > 500 THEN concat(left({text}, 500), '… [truncated]') ELSE {text} END"
    return f"coalesce(CAST(to_json({cut}) AS VARCHAR), 'null')"


_SIZE = "CAST(ceil(length(text) / 20) AS BIGINT)"
_AFTER_PARTS = ", ',', ".join(
    f"'\"{name}\":', {_shown(f'substring(text, {place} * {_SIZE} + 1, {_SIZE})')}" for place, name in enumerate(PARTS)
)
_FIELD_NAMES = ",".join(f'"{name}"' for name in PARTS)
DOCUMENT_ENTRIES = f"""SELECT source AS run_id, n AS place, 'quality' AS kind, concat('V', n) AS id,
  concat('{{"row":', doc_id, ',"column":"text","code":"type","message":"Expected a valid English value.","value":',
    {_shown("text")}, ',"id":"V', n, '"}}') AS payload
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE lang <> 'en') AS f WHERE n <= 20
UNION ALL SELECT source, CAST(21 AS BIGINT), 'schema', 'C1', concat('{{"id":"C1","kind":"schema","added":["',
  string_agg(DISTINCT lang, '","' ORDER BY lang), '"],"removed":[]}}') FROM documents WHERE lang <> 'en' GROUP BY source
UNION ALL SELECT source, n + 21, 'change', concat('C', n + shift), concat('{{"kind":"added","key":"', doc_id,
  '","before":null,"after":{{', {_AFTER_PARTS}, '}},"fields":[{_FIELD_NAMES}],"id":"C', n + shift, '"}}')
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CAST(doc_id AS VARCHAR)) AS n,
  CAST(bool_or(lang <> 'en') OVER (PARTITION BY source) AS BIGINT) AS shift FROM documents) AS d WHERE n <= 20"""
# The document without entries: totals of both checks and the bounds it states.
_FRAME = """concat('{"quality_summary":{"rows":', n, ',"issues":', marked, ',"affected_rows":', marked,
  ',"reported_findings":', least(marked, 500), '},"change_summary":{"before_rows":0,"after_rows":', n, ',"added":', n,
  ',"removed":0,"changed":0,"unchanged":0,"total_changes":', n, ',"reported_findings":', least(n, 500),
  '},"evidence":[],"truncation":{"applied":false,"max_findings_per_source":20,"max_string_characters":500,',
  '"max_collection_items":20,"max_evidence_bytes":65536,"quality_available_findings":', least(marked, 500),
  ',"quality_included_findings":0,"change_available_findings":', least(n, 500),
  ',"change_included_findings":0,"schema_evidence_included":false}}')"""


@query(
    "evd_04_evidence_budget",
    f"""SELECT run_id, place, id, size FROM (WITH RECURSIVE
entries AS MATERIALIZED (SELECT run_id, place, kind, id, strlen(payload) AS size,
  row_number() OVER (PARTITION BY run_id ORDER BY place) AS step FROM ({DOCUMENT_ENTRIES}) AS candidates),
totals AS (SELECT source AS run_id, count(*) AS n, count(*) FILTER (lang <> 'en') AS marked FROM documents GROUP BY source),
walk AS (
  SELECT run_id, CAST(0 AS BIGINT) AS step, CAST(strlen({_FRAME}) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS quality,
    CAST(0 AS BIGINT) AS change, CAST(0 AS BIGINT) AS schema, false AS fits FROM totals
  UNION ALL SELECT run_id, step, CASE WHEN fits THEN grown ELSE bytes END,
    quality + CAST(fits AND kind = 'quality' AS BIGINT), change + CAST(fits AND kind = 'change' AS BIGINT),
    schema + CAST(fits AND kind = 'schema' AS BIGINT), fits
  FROM (SELECT *, grown + CAST(quality > 9 AS BIGINT) + CAST(change > 9 AS BIGINT) - schema <= 65536 - 256 AS fits
    FROM (SELECT w.run_id, e.step, e.kind, w.bytes, w.quality, w.change, w.schema,
        w.bytes + e.size + CAST(w.quality + w.change + w.schema > 0 AS BIGINT) AS grown
      FROM walk AS w JOIN entries AS e ON e.run_id = w.run_id AND e.step = w.step + 1) AS offered) AS tried)
SELECT e.run_id, e.place, e.id, e.size FROM walk AS w JOIN entries AS e ON e.run_id = w.run_id AND e.step = w.step
WHERE w.fits) AS kept""",
)
def _(t):
    """Entries of document runs are long: many do not fit, later ones may."""
    kept = e.evidence_budget(document_runs(t))
    size = F.octet_length("payload").cast("bigint").alias("size")
    return kept.select("run_id", F.col("place").cast("bigint").alias("place"), "id", size)


@query(
    "evd_04_evidence_budget_orders",
    f"SELECT run_id, place, id, strlen(payload) AS size FROM ({ENTRIES}) AS entries",
)
def _(t):
    """Entries of order runs are short: every one fits."""
    kept = e.evidence_budget(run_results(t))
    size = F.octet_length("payload").cast("bigint").alias("size")
    return kept.select("run_id", F.col("place").cast("bigint").alias("place"), "id", size)


@query(
    "evd_05_truncation_metadata",
    f"""SELECT t.run_id, least(issues, 500) AS quality_available, least(issues, 20) AS quality_included,
  least(total_changes, 500) AS change_available, least(total_changes, 20) AS change_included,
  schema_changes > 0 AS schema_included, issues > 20 OR total_changes > 20 AS applied,
  CAST(coalesce(s.bytes, 0) AS BIGINT) AS evidence_bytes
FROM ({RUN_TOTALS}) AS t LEFT JOIN (SELECT run_id, sum(strlen(payload)) + count(*) - 1 AS bytes
  FROM ({ENTRIES}) AS entries GROUP BY run_id) AS s ON s.run_id = t.run_id""",
)
def _(t):
    return e.truncation_metadata(run_results(t))


@query(
    "brf_01_briefing_summary",
    f"""SELECT run_id, concat('Quality check: ', issues, ' issues across ', affected_rows, ' of ', rows,
  ' records. Snapshot comparison: ', added, ' added, ', removed, ' removed, ', changed, ' changed, and ', unchanged,
  ' unchanged records. Schema: ', schema_changes, ' added and ', schema_changes,
  ' removed columns. Totals include findings omitted from the detailed samples.') AS summary
FROM ({RUN_TOTALS}) AS totals""",
)
def _(t):
    return b.briefing_summary(run_results(t))


@query(
    "brf_02_briefing_actions",
    f"""SELECT a.run_id, CASE WHEN prefix = 'V' THEN 'Review the validation findings before importing this export.'
  ELSE 'Review the snapshot changes against the expected business updates.' END AS title,
  CASE WHEN prefix = 'V' THEN 'high' ELSE 'medium' END AS priority, ids AS evidence_ids
FROM (SELECT run_id, prefix, string_agg(id, '|' ORDER BY place) AS ids FROM (SELECT *, left(id, 1) AS prefix,
  row_number() OVER (PARTITION BY run_id, left(id, 1) ORDER BY place) AS n FROM ({ENTRIES}) AS entries) AS ranked
  WHERE n <= 5 GROUP BY run_id, prefix) AS a JOIN ({RUN_TOTALS}) AS t ON t.run_id = a.run_id
WHERE (prefix = 'V' AND issues > 0) OR (prefix = 'C' AND total_changes + schema_changes > 0)""",
)
def _(t):
    results = run_results(t)
    actions = b.briefing_actions(results, e.evidence_budget(results))
    return actions.select("run_id", "title", "priority", F.array_join("evidence_ids", "|").alias("evidence_ids"))


_FOCUS = "CASE WHEN contains(lower(text), 'change') OR contains(lower(text), 'snapshot') THEN 'changes' ELSE 'validation' END"


@query(
    "brf_03_revision_sections",
    f"""SELECT CAST(conv_id AS VARCHAR) AS run_id, turn + 1 AS number, {_FOCUS} AS focus,
  CASE WHEN {_FOCUS} = 'changes' THEN 'Snapshot changes by order ID|Validation issues by source record'
    ELSE 'Validation issues by source record|Snapshot changes by order ID' END AS sections,
  concat('Base of ', conv_id, chr(10), chr(10), 'Revision ', turn + 1, ': see the ', {_FOCUS}, ' details first. ',
    'Validation details identify source rows, fields, values, and rule explanations; snapshot details identify ',
    'order keys, changed fields, and before/after values.') AS summary
FROM (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN concat(text, ' Snapshot?') ELSE text END AS text
  FROM conversations) AS said""",
)
def _(t):
    """Conversation turns as feedback; a third of them ask about the snapshot."""
    said = t["conversations"].select(
        F.col("conv_id").cast("string").alias("run_id"),
        (F.col("turn") + 1).alias("number"),
        F.concat(F.lit("Base of "), F.col("conv_id").cast("string")).alias("original_summary"),
        F.when(F.length("text") % 3 == 0, F.concat("text", F.lit(" Snapshot?"))).otherwise(F.col("text")).alias("feedback"),
    )
    return b.revision_sections(said).withColumn("sections", F.array_join("sections", "|"))


@query(
    "brf_04_citation_check",
    f"""SELECT d.run_id, briefing_id, CASE shape WHEN 0 THEN CASE WHEN v1 AND c1 THEN '' ELSE 'evidence_ids' END
  WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'not_an_object' WHEN 3 THEN 'wrong_keys' WHEN 4 THEN 'summary'
  WHEN 5 THEN 'summary' WHEN 6 THEN 'actions' WHEN 7 THEN 'action_keys' WHEN 8 THEN 'title' WHEN 9 THEN 'priority'
  WHEN 10 THEN 'evidence_ids' WHEN 11 THEN 'evidence_ids'
  WHEN 12 THEN CASE WHEN e.id IS NOT NULL THEN '' ELSE 'evidence_ids' END ELSE 'evidence_ids' END AS problem
FROM briefing_docs AS d
LEFT JOIN (SELECT run_id, bool_or(id = 'V1') AS v1, bool_or(id = 'C1') AS c1 FROM ({ENTRIES}) AS entries
  GROUP BY run_id) AS f ON f.run_id = d.run_id
LEFT JOIN ({ENTRIES}) AS e ON e.run_id = d.run_id AND e.id = concat('V', 1 + briefing_id % 40)""",
)
def _(t):
    kept = e.evidence_budget(run_results(t)).select("run_id", "id")
    return b.citation_check(t["briefing_docs"], kept)


_APPROVED = "round <= 2 AND shape = 0"


@query(
    "brf_05_review_outcome",
    f"""SELECT run_id, count(*) FILTER ({_APPROVED}) > 0 AS approved,
  coalesce(min(round) FILTER ({_APPROVED}), max(round)) AS rounds,
  CASE WHEN count(*) FILTER ({_APPROVED}) = 0 THEN arg_max(CASE shape WHEN 1 THEN 'malformed review'
    WHEN 2 THEN 'unusable feedback' WHEN 3 THEN 'rejection without feedback' WHEN 4 THEN 'malformed review'
    WHEN 5 THEN 'malformed review' ELSE concat('see ', n) END, round) END AS last_feedback
FROM review_docs WHERE round <= 2 GROUP BY run_id""",
)
def _(t):
    return b.review_outcome(t["review_docs"].select("run_id", "round", "content"))


@query(
    "brf_06_review_history_bound",
    """SELECT source AS run_id, doc_id AS round, quality = 1 AS approved, left(text, 2000) AS feedback
FROM (SELECT d.*, l.quality, row_number() OVER (PARTITION BY source ORDER BY d.doc_id) AS n
  FROM documents AS d LEFT JOIN labels AS l ON l.doc_id = d.doc_id) AS ranked
WHERE n <= 3 AND quality IS NOT NULL""",
)
def _(t):
    """Documents of one source as its rounds; those without a label are malformed."""
    labels = t["labels"].select("doc_id", (F.col("quality") == 1).alias("approved"))
    rounds = t["documents"].join(labels, "doc_id", "left").select(
        F.col("source").alias("run_id"), F.col("doc_id").alias("round"), "approved", F.col("text").alias("feedback")
    )
    return b.review_history_bound(rounds)


@query(
    "ver_01_recompute_equal",
    """SELECT 'same' AS pair, CAST(0 AS BIGINT) AS only_stored, CAST(0 AS BIGINT) AS only_fresh
UNION ALL SELECT 'altered', count(*) FILTER (status = 'P'), count(*) FILTER (status = 'P') FROM before_orders""",
)
def _(t):
    """Stored findings against fresh ones, and against altered ones."""
    orders = t["before_orders"]
    rules = {"version": 1, "columns": {"status": {"allowed": ["F", "O"]}}}
    fresh = v.all_findings(orders, rules)
    stored = written(fresh, "stored-findings")
    altered = fresh.withColumn("message", F.concat("message", F.lit("!")))
    frames = [
        x.recompute_equal(stored, other).select(F.lit(pair).alias("pair"), "only_stored", "only_fresh")
        for pair, other in (("same", fresh), ("altered", altered))
    ]
    return frames[0].unionByName(frames[1])


def _later_html():
    """Contents of pages later on: at addresses with an anchor they have grown. That
    changes any of them, also empty ones, NULLs and those without small letters."""
    grown = F.concat(F.coalesce("html", F.lit("")), F.lit("<!-- altered since receipt -->"))
    return F.when(F.contains("url", F.lit("#")), grown).otherwise(F.col("html"))


@query(
    "ver_02_input_drift",
    """SELECT url AS path, CASE WHEN contains(url, '?') THEN 'missing' ELSE 'changed' END AS problem FROM pages
WHERE contains(url, '?') OR contains(url, '#')""",
)
def _(t):
    """Pages at receipt and later: addresses with a query moved, ones with an
    anchor changed."""
    pages = t["pages"]
    received = pages.select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"))
    moved = F.when(F.contains("url", F.lit("?")), F.concat("url", F.lit("&moved"))).otherwise(F.col("url"))
    current = pages.select(moved.alias("path"), F.sha2(_later_html(), 256).alias("sha256"))
    return x.input_drift(received, current)


@query(
    "ver_02_table_drift",
    """SELECT 'same' AS pair, false AS drifted, count(*) AS rows FROM lineitem
UNION ALL SELECT 'altered', true, count(*) FROM lineitem""",
)
def _(t):
    """The fingerprint of all order lines, in another order, and with a changed tax."""
    lines = t["lineitem"]
    altered = lines.withColumn("l_tax", F.col("l_tax") + F.when(F.col("l_returnflag") == "R", 0.01).otherwise(0))
    base = x.table_fingerprint(lines)
    frames = []
    for pair, other in (("same", lines.sort("l_shipdate")), ("altered", altered)):
        now = x.table_fingerprint(other)
        both = base.unionByName(now).agg(
            (F.count_distinct("rows", "mixed", "total") > 1).alias("drifted"), F.max("rows").alias("rows")
        )
        frames.append(both.select(F.lit(pair).alias("pair"), "drifted", "rows"))
    return frames[0].unionByName(frames[1])


@query(
    "ver_03_verification_checks",
    """SELECT 'source_identity' AS "check", count(*) FILTER (contains(url, '#')) AS violations,
  count(*) FILTER (contains(url, '#')) = 0 AS passed FROM pages
UNION ALL SELECT 'result_schema', CAST(0 AS BIGINT), true
UNION ALL SELECT 'summary_counts', CAST(0 AS BIGINT), true
UNION ALL SELECT 'engine_recomputation', CAST(0 AS BIGINT), true""",
)
def _(t):
    accounts, pages = t["accounts"], t["pages"]
    fresh = v.validate(accounts, ACCOUNT_RULES)
    stored, stored_summary = written(fresh.all_findings, "stored"), written(fresh.summary, "stored-summary")
    received = pages.select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"))
    drift = x.input_drift(received, pages.select(F.col("url").alias("path"), F.sha2(_later_html(), 256).alias("sha256")))
    return x.verification_checks(stored, fresh.all_findings, stored_summary, fresh.summary, drift)


@query(
    "ver_04_count_invariants",
    f"""SELECT "check", CAST(sum(violations) AS BIGINT) AS violations FROM (
SELECT unnest(['affected_within_rows', 'reported_within_issues', 'affected_within_issues']) AS "check",
  unnest([CAST(affected_rows > rows AS BIGINT), CAST(reported_findings > issues AS BIGINT),
    CAST(affected_rows > issues AS BIGINT)]) AS violations FROM ({TOTALS}) AS quality
UNION ALL SELECT unnest(['after_rows_add_up', 'before_rows_add_up', 'changes_add_up', 'reported_within_changes']),
  unnest([CAST(added + changed + unchanged <> after_rows AS BIGINT), CAST(removed + changed + unchanged <> before_rows AS BIGINT),
    CAST(added + removed + changed <> total_changes AS BIGINT), CAST(reported_findings > total_changes AS BIGINT)])
  FROM ({SUMMARY}) AS changes) AS checks GROUP BY "check\"""",
)
def _(t):
    """Invariants over the summaries of every run."""
    results = run_results(t)
    quality = x.count_invariants(results.quality_summary, x.QUALITY_INVARIANTS)
    return quality.unionByName(x.count_invariants(results.change_summary, x.CHANGE_INVARIANTS))
