"""Inputs of the queries, derived from the given tables.

Every text below runs unchanged in Spark and in the checking engine, apart from
the functions in ``Dialect``. All of them read whole tables: rows are relabelled,
never left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Dialect:
    """The few functions the two engines spell differently."""

    sha: str
    stamp: str
    plus_seconds: str
    div: str


SPARK = Dialect(
    sha="sha2({0}, 256)",
    stamp="date_format({0}, 'yyyy-MM-dd''T''HH:mm:ss.SSSSSS')",
    plus_seconds="timestampadd(SECOND, {1}, {0})",
    div="(({0}) div ({1}))",
)
CHECK = Dialect(
    sha="sha256({0})",
    stamp="strftime({0}, '%Y-%m-%dT%H:%M:%S.%f')",
    plus_seconds="({0} + to_seconds({1}))",
    div="(({0}) // ({1}))",
)

_CALL = re.compile(r"@(sha|stamp|plus_seconds|div)\(")


def _arguments(text: str, start: int) -> tuple[list[str], int]:
    depth, piece, pieces = 1, start, []
    quoted = False
    for place in range(start, len(text)):
        mark = text[place]
        if mark == "'":
            quoted = not quoted
        if quoted:
            continue
        if mark == "(":
            depth += 1
        elif mark == ")":
            depth -= 1
            if not depth:
                pieces.append(text[piece:place].strip())
                return pieces, place + 1
        elif mark == "," and depth == 1:
            pieces.append(text[piece:place].strip())
            piece = place + 1
    raise ValueError("unclosed call")


def spell(text: str, dialect: Dialect) -> str:
    """Replace ``@name(...)`` by the function of one engine."""
    found = _CALL.search(text)
    while found:
        pieces, end = _arguments(text, found.end())
        pieces = [spell(piece, dialect) for piece in pieces]
        text = text[: found.start()] + getattr(dialect, found[1]).format(*pieces) + text[end:]
        found = _CALL.search(text)
    return text


#: The number in an event's ``{"k": 69}`` text.
_K = "CAST(substring(props, 7, length(props) - 7) AS BIGINT)"

TEXTS: dict[str, str] = {}

# --- datasets to check and to compare ----------------------------------------

TEXTS["accounts"] = """
SELECT CAST(c_custkey + 2 AS BIGINT) AS record_no,
  CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN '  '
    WHEN 2 THEN concat(' ', CAST(c_custkey AS STRING), ' ')
    WHEN 3 THEN concat('N', CAST(c_nationkey AS STRING))
    ELSE CAST(c_custkey AS STRING) END AS account_id,
  CASE WHEN c_nationkey % 5 = 0 THEN replace(c_name, '#', '@')
    WHEN c_nationkey % 5 = 1 THEN ''
    ELSE concat(replace(c_name, '#', '@'), '.com') END AS email,
  CASE c_nationkey WHEN 7 THEN concat(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING), 'e1')
    WHEN 8 THEN replace(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING), '.', ',')
    WHEN 9 THEN concat(' ', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING))
    ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) END AS balance,
  CASE WHEN c_nationkey % 4 = 0 THEN CAST(c_acctbal > 0 AS STRING)
    WHEN c_nationkey % 4 = 1 THEN concat('+', CAST(c_nationkey AS STRING))
    ELSE CAST(c_nationkey AS STRING) END AS region_code,
  concat(c_mktsegment, CASE WHEN c_nationkey = 3 THEN ' ' ELSE '' END) AS segment,
  concat('2026-02-', CASE WHEN c_nationkey = 4 THEN CAST(c_custkey % 32 AS STRING)
    ELSE lpad(CAST(c_custkey % 32 AS STRING), 2, '0') END) AS joined
FROM customer
"""

# Accounts with blanks of two forms in every column.
TEXTS["blanked_accounts"] = """
SELECT record_no, account_id, CASE WHEN record_no % 7 = 0 THEN ' ' ELSE email END AS email,
  CASE record_no % 5 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE balance END AS balance,
  CASE record_no % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE region_code END AS region_code,
  CASE record_no % 6 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE segment END AS segment,
  CASE record_no % 3 WHEN 0 THEN ' ' ELSE joined END AS joined
FROM accounts
"""

TEXTS["texts"] = """
SELECT CAST(doc_id + 2 AS BIGINT) AS record_no, text, lang, source FROM documents
"""

TEXTS["before_orders"] = """
SELECT CAST(o_orderkey + 2 AS BIGINT) AS record_no,
  CASE WHEN o_orderpriority = '2-HIGH' THEN concat(' ', CAST(o_orderkey AS STRING))
    ELSE CAST(o_orderkey AS STRING) END AS order_id,
  CAST(o_custkey AS STRING) AS customer,
  o_orderstatus AS status,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS total,
  @stamp(o_orderdate) AS placed,
  o_orderpriority AS priority
FROM orders
"""

# Every order is in the later snapshot too; urgent pending ones under a new key.
TEXTS["after_orders"] = """
SELECT CAST(o_orderkey + 2 AS BIGINT) AS record_no,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
    THEN concat('R', CAST(o_orderkey AS STRING))
    ELSE concat(CAST(o_orderkey AS STRING), ' ') END AS order_id,
  CAST(o_custkey AS STRING) AS customer,
  CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 'F'
    ELSE o_orderstatus END AS status,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '3-MEDIUM'
    THEN concat(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '0')
    WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' AND o_totalprice > 250000
    THEN concat(' ', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING))
    ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS total,
  @stamp(o_orderdate) AS placed,
  concat('W', CAST(o_custkey % 7 AS STRING)) AS warehouse
FROM orders
"""

# Order lines keyed by order: one key on many rows, and blank keys.
TEXTS["keyed_lines"] = """
SELECT CAST(p_partkey + 2 AS BIGINT) AS record_no,
  CASE WHEN p_size = 11 THEN ' ' ELSE concat(p_name, ' ') END AS item_key,
  p_brand AS brand
FROM part
"""


# Rule documents, one per part: sound ones, and every kind of unsound one.
TEXTS["rule_docs"] = """
SELECT p_partkey AS rule_set, p_size AS shape, p_name, p_type, CASE p_size
  WHEN 1 THEN '{"version":1,"columns":{"a":{}}} trailing'
  WHEN 2 THEN '["version"]'
  WHEN 3 THEN '{"version":1,"columns":{},"extra":0}'
  WHEN 4 THEN '{"version":true,"columns":{}}'
  WHEN 5 THEN '{"version":1,"columns":[]}'
  WHEN 6 THEN '{"version":1,"columns":{" ":{}}}'
  WHEN 7 THEN concat('{"version":1,"columns":{"', p_name, '":[]}}')
  WHEN 8 THEN concat('{"version":1,"columns":{"', p_name, '":{"default":1}}}')
  WHEN 9 THEN concat('{"version":1,"columns":{"', p_name, '":{"required":1}}}')
  WHEN 10 THEN concat('{"version":1,"columns":{"', p_name, '":{"unique":"yes"}}}')
  WHEN 11 THEN concat('{"version":1,"columns":{"', p_name, '":{"type":"float"}}}')
  WHEN 12 THEN concat('{"version":1,"columns":{"', p_name, '":{"min":1}}}')
  WHEN 13 THEN concat('{"version":1,"columns":{"', p_name, '":{"type":"number","min":"1"}}}')
  WHEN 14 THEN concat('{"version":1,"columns":{"', p_name, '":{"type":"number","max":true}}}')
  WHEN 15 THEN concat('{"version":1,"columns":{"', p_name, '":{"type":"integer","min":3,"max":2}}}')
  WHEN 16 THEN concat('{"version":1,"columns":{"', p_name, '":{"allowed":[]}}}')
  WHEN 17 THEN concat('{"version":1,"columns":{"', p_name, '":{"allowed":["a",2]}}}')
  WHEN 18 THEN concat('{"version":1,"columns":{"', p_name, '":{},"', p_name, '":{}}}')
  WHEN 19 THEN concat('{"version":1,"columns":{"', p_name, '":{"type":"number","min":NaN}}}')
  WHEN 20 THEN concat('{"version":1,"columns":{"', p_name, '":{"type":null}}}')
  ELSE concat('{"version":1,"columns":{"z ', p_name, '":{"required":true,"unique":true},"b":{"type":"number","min":',
    CAST(p_size AS STRING), ',"max":', CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING),
    '},"a":{"allowed":["', p_type, '","x"]}}}') END AS doc
FROM part
"""

# Order lines as an export: every column as text. A line has no single key, so
# records are numbered by the place of the row in its file where that matters.
TEXTS["line_cells"] = """
SELECT CAST(l_orderkey AS STRING) AS order_id,
  concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS line_id,
  concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
    CAST(l_suppkey AS STRING), CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)) AS full_id,
  CAST(CAST(l_quantity AS DECIMAL(18,2)) AS STRING) AS quantity,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS price,
  CAST(CAST(l_discount AS DECIMAL(18,2)) AS STRING) AS discount,
  l_returnflag AS flag, l_linestatus AS state, substring(@stamp(l_shipdate), 1, 10) AS shipped
FROM lineitem
"""

# --- batches of runs -------------------------------------------------------------

# Ten customers make one run; its export has their orders, old and new.
TEXTS["run_before"] = """
SELECT concat('run-', CAST(@div(CAST(customer AS BIGINT), 10) AS STRING)) AS run_id, * FROM before_orders
"""

TEXTS["run_after"] = """
SELECT concat('run-', CAST(@div(CAST(customer AS BIGINT), 10) AS STRING)) AS run_id, * FROM after_orders
"""

TEXTS["briefing_docs"] = """
SELECT concat('run-', CAST(doc_id % 150 AS STRING)) AS run_id, doc_id AS briefing_id, shape, CASE shape
  WHEN 0 THEN '{"summary":"ok","actions":[{"title":"look","priority":"high","evidence_ids":["V1","C1"]}]}'
  WHEN 1 THEN '{"summary":"ok","actions":[]} x'
  WHEN 2 THEN '["summary"]'
  WHEN 3 THEN '{"summary":"ok","actions":[],"note":1}'
  WHEN 4 THEN '{"summary":" ","actions":[]}'
  WHEN 5 THEN concat('{"summary":"', repeat('s', 4001), '","actions":[]}')
  WHEN 6 THEN '{"summary":"ok","actions":{}}'
  WHEN 7 THEN '{"summary":"ok","actions":[{"title":"look","priority":"high"}]}'
  WHEN 8 THEN '{"summary":"ok","actions":[{"title":7,"priority":"high","evidence_ids":["V1"]}]}'
  WHEN 9 THEN '{"summary":"ok","actions":[{"title":"look","priority":"urgent","evidence_ids":["V1"]}]}'
  WHEN 10 THEN '{"summary":"ok","actions":[{"title":"look","priority":"low","evidence_ids":["V1","V1"]}]}'
  WHEN 11 THEN '{"summary":"ok","actions":[{"title":"look","priority":"low","evidence_ids":[]}]}'
  WHEN 12 THEN concat('{"summary":"ok","actions":[{"title":"look","priority":"low","evidence_ids":["V',
    CAST(1 + doc_id % 40 AS STRING), '"]}]}')
  ELSE '{"summary":"ok","actions":[{"title":"a","priority":"low","evidence_ids":["C1"]},{"title":"b","priority":"low","evidence_ids":["C1",2]}]}'
  END AS content
FROM (SELECT *, doc_id % 7 * 2 + CASE WHEN toxic = 1 THEN quality ELSE 1 - quality END AS shape FROM labels) AS shaped
"""

TEXTS["review_docs"] = """
SELECT CAST(conv_id AS STRING) AS run_id, turn + 1 AS round, shape, n, CASE shape
  WHEN 0 THEN '{"approved":true,"feedback":""}'
  WHEN 1 THEN '{"approved":"yes","feedback":"fine"}'
  WHEN 2 THEN concat('{"approved":true,"feedback":"', repeat('x', 2001), '"}')
  WHEN 3 THEN '{"approved":false,"feedback":" "}'
  WHEN 4 THEN '{"approved":true}'
  WHEN 5 THEN '{broken'
  ELSE concat('{"approved":false,"feedback":"see ', CAST(n AS STRING), '"}') END AS content
FROM (SELECT conv_id, turn, length(text) AS n, length(text) % 9 AS shape FROM conversations) AS shaped
"""

# --- submissions ---------------------------------------------------------------

# One file per part; few distinct contents under many names, some too large.
TEXTS["source_files"] = """
SELECT concat('inbox/data/', CAST(p_partkey AS STRING), '.csv') AS path,
  CAST(p_size * 250000 AS BIGINT) AS length, @sha(p_name) AS sha256
FROM part
"""

TEXTS["receipt_parts"] = f"""
SELECT event_id AS receipt_seq, user_id, event_type AS shape, {_K} AS k,
  substring(@stamp(ts), 1, 10) AS scan_id,
  concat('inbox/job-', CAST(user_id AS STRING), '.json') AS path,
  concat('data/', CAST({_K} AS STRING), '.csv') AS file,
  concat('"rules":"data/', CAST(@div({_K}, 10) AS STRING), '.csv","before":"data/1.csv","after":"data/2.csv"') AS rest
FROM events
"""

TEXTS["receipts"] = """
SELECT receipt_seq, scan_id, path, @sha(doc) AS raw_hash, doc FROM (
SELECT *, CASE shape
  WHEN 'view' THEN concat('{"event_type":"orders_check","input":"', file, '",', rest, '}')
  WHEN 'signup' THEN concat('{"key":" order_id ","event_id":"user-', CAST(user_id AS STRING),
    '","event_type":"orders_check","input":"', file, '",', rest, '}')
  WHEN 'purchase' THEN concat('{"event_type":"orders_check","key":"alt","event_id":"buy-', CAST(k AS STRING),
    '","input":"', file, '",', rest, '}')
  WHEN 'click' THEN concat('{"event_type":"orders_check",', rest, ',"input":"', CASE
    WHEN k < 20 THEN concat('../', file) WHEN k < 40 THEN concat('/', file) WHEN k < 60 THEN concat('C:', file)
    WHEN k < 70 THEN concat('./x/../', file) WHEN k < 80 THEN concat('../inbox/', file)
    ELSE concat(file, '.absent') END, '"}')
  ELSE CASE WHEN k < 10 THEN '{broken' WHEN k < 20 THEN '["orders_check"]'
    WHEN k < 30 THEN concat('{"event_type":"orders_check","event_type":"other",', rest, '}')
    WHEN k < 40 THEN concat('{"event_type":"orders_check","key":NaN,', rest, '}')
    WHEN k < 50 THEN concat('{"event_type":"orders_check","input":"', file, '",', rest, '} {}')
    WHEN k < 55 THEN concat('{"event_type":"orders_check",', rest, '}')
    WHEN k < 60 THEN concat('{"event_type":"orders_check","module":"x","input":"', file, '",', rest, '}')
    WHEN k < 70 THEN concat('{"event_type":"orders_check","input":', CAST(k AS STRING), ',', rest, '}')
    WHEN k < 75 THEN concat('{"event_type":"orders_check","key":" ","input":"', file, '",', rest, '}')
    WHEN k < 80 THEN concat('{"event_type":"other","input":"', file, '",', rest, '}')
    WHEN k < 85 THEN concat('{"event_type":"orders_check","key":"a', chr(92), 'tb","input":"', file, '",', rest, '}')
    WHEN k < 90 THEN concat('{"event_type":"orders_check","event_id":"', repeat('a', 257), '","input":"', file, '",', rest, '}')
    ELSE concat('{"event_type":"orders_check","event_id":null,"input":"', file, '",', rest, '}') END
  END AS doc FROM receipt_parts) AS written_docs
"""

TEXTS["event_rows"] = """
SELECT concat('evt_', CAST(o_orderkey AS STRING)) AS id,
  concat('content:', CAST(o_custkey AS STRING), ':', @stamp(o_orderdate)) AS identity_key,
  concat('user-', CAST(o_custkey AS STRING)) AS event_id,
  concat('inbox/job-', CAST(o_orderkey AS STRING), '.json') AS manifest_path,
  @sha(concat(CAST(o_custkey AS STRING), o_orderpriority, @stamp(o_orderdate))) AS fingerprint,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'FAILED' WHEN '2-HIGH' THEN 'INVALID'
    WHEN '3-MEDIUM' THEN 'VALIDATED' WHEN '4-NOT SPECIFIED' THEN 'CLAIMED'
    ELSE 'WORKFLOW_CREATED' END AS status,
  CASE WHEN o_orderpriority = '2-HIGH' AND o_totalprice < 450000 THEN NULL
    ELSE left(@sha(CAST(o_orderkey AS STRING)), 32) END AS workflow_run_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'changed input' END AS error,
  @stamp(o_orderdate) AS received_at
FROM orders
"""

TEXTS["run_rows"] = """
SELECT left(@sha(CAST(o_orderkey AS STRING)), 32) AS run_id,
  CASE WHEN o_orderstatus = 'F' THEN 'SUCCEEDED'
    WHEN o_orderstatus = 'O' AND o_totalprice > 250000 THEN 'FAILED'
    WHEN o_orderstatus = 'O' THEN 'RUNNING'
    WHEN o_totalprice > 250000 THEN 'WAITING_FOR_APPROVAL' ELSE 'PENDING' END AS status,
  CASE WHEN o_orderstatus = 'O' AND o_totalprice > 250000
    THEN concat('task failed for ', CAST(o_custkey AS STRING)) END AS failure_reason,
  concat('{"key":"order_id","llm_url":', CASE WHEN o_orderpriority = '5-LOW' THEN '"http://127.0.0.1:8080"'
    ELSE 'null' END, ',"max_human_revisions":', CAST(1 + o_custkey % 4 AS STRING), '}') AS config_json,
  @stamp(o_orderdate) AS created_at
FROM orders
"""

TEXTS["run_limits"] = """
SELECT left(@sha(CAST(o_orderkey AS STRING)), 32) AS run_id,
  CASE WHEN o_totalprice > 400000 THEN 'revision_limit_reached' ELSE 'run_completed' END AS event
FROM orders
"""

TEXTS["event_log"] = f"""
SELECT event_id AS id, CAST(user_id AS STRING) AS ingestion_id, @stamp(ts) AS logged_at,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' WHEN 'signup' THEN 'CLAIMED'
    ELSE 'WORKFLOW_CREATED' END AS status,
  CASE WHEN event_type = 'error' THEN concat('error ', CAST(@div({_K}, 50) AS STRING)) END AS error
FROM events
"""

# --- run history ---------------------------------------------------------------

TEXTS["run_log"] = f"""
SELECT event_id AS id, CAST(user_id AS STRING) AS run_id, @stamp(ts) AS logged_at, event_name AS event,
  CASE WHEN event_name <> 'run_resumed' THEN task_name END AS task, k,
  CASE WHEN event_name = 'task_failed' THEN concat('{{"error":"', error_name, ': no ', CAST(k AS STRING), '"}}')
    ELSE concat('{{"attempt":"', CAST(k AS STRING), '"}}') END AS detail_json,
  CASE WHEN event_name = 'task_failed' THEN concat(error_name, ': no ', CAST(k AS STRING)) END AS error
FROM (SELECT event_id, ts, user_id, {_K} AS k,
  CASE event_type WHEN 'view' THEN 'task_started' WHEN 'purchase' THEN 'task_succeeded'
    WHEN 'error' THEN 'task_failed' WHEN 'click' THEN 'task_retrying'
    ELSE CASE WHEN {_K} % 2 = 0 THEN 'task_reused' ELSE 'run_resumed' END END AS event_name,
  CASE {_K} % 5 WHEN 0 THEN 'planner' WHEN 1 THEN 'quality_agent' WHEN 2 THEN 'change_agent'
    WHEN 3 THEN 'verifier' ELSE 'briefing_agent' END AS task_name,
  CASE {_K} % 3 WHEN 0 THEN 'TimeoutError' WHEN 1 THEN 'ConnectionResetError' ELSE 'ValueError' END AS error_name
  FROM events) AS named
"""

TEXTS["task_rows"] = """
SELECT run_id, task_id, attempts, last_error AS error,
  CASE last_event WHEN 'task_succeeded' THEN 'succeeded' WHEN 'task_failed' THEN 'failed'
    WHEN 'task_started' THEN 'running' ELSE 'pending' END AS status,
  CASE WHEN last_event = 'task_succeeded' THEN concat('{"summary":{"',
    CASE WHEN task_id = 'change_agent' THEN 'total_changes' ELSE 'issues' END, '":', CAST(attempts AS STRING), '}}')
    END AS output_json
FROM (SELECT run_id, task AS task_id, max_by(event, id) AS last_event,
  count(CASE WHEN event = 'task_started' THEN 1 END) AS attempts,
  max_by(CASE WHEN event = 'task_failed' THEN error ELSE '' END, id) AS last_error
  FROM run_log WHERE task IS NOT NULL GROUP BY run_id, task) AS folded
"""

TEXTS["approval_rows"] = """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn + 1 AS STRING)) AS id,
  CAST(conv_id AS STRING) AS run_id, turn + 1 AS iteration, kind AS status,
  CASE WHEN kind <> 'pending' OR length(text) % 7 = 0 THEN kind END AS decision,
  CASE WHEN kind <> 'pending' AND length(text) % 11 > 0 THEN 'decided' END AS decided_at,
  text AS comment
FROM (SELECT *, CASE WHEN role = 'system' OR (role = 'user' AND length(text) % 5 = 0) THEN 'pending'
  WHEN role = 'assistant' AND length(text) % 3 = 0 THEN 'approved' ELSE 'rejected' END AS kind
  FROM conversations) AS kinds
"""

# Heads of runs, one per customer, with the event and the job each came from; some
# runs have no event or no job.
TEXTS["run_heads"] = """
SELECT CAST(c_custkey AS STRING) AS run_id, CASE WHEN c_nationkey % 3 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
  CASE WHEN c_nationkey % 3 = 0 THEN concat('failed "', c_mktsegment, '"') END AS failure_reason,
  CASE WHEN c_nationkey % 4 = 0 THEN '{"llm_url":"local:8080"}' WHEN c_nationkey % 4 = 1 THEN '{"llm_url":""}'
    ELSE '{"llm_url":null}' END AS config_json
FROM customer
"""

TEXTS["head_events"] = """
SELECT concat('evt_', CAST(c_custkey AS STRING)) AS id, c_name AS event_id, 'csv.ready' AS event_type,
  concat('inbox/', c_mktsegment, '.json') AS manifest_path, @sha(c_name) AS fingerprint, 'WORKFLOW_CREATED' AS status,
  CASE WHEN c_nationkey % 7 > 0 THEN CAST(c_custkey AS STRING) END AS workflow_run_id
FROM customer
"""

TEXTS["head_jobs"] = """
SELECT concat('job_', CAST(c_custkey AS STRING)) AS id, CASE WHEN c_acctbal < 0 THEN 'DEAD_LETTER' ELSE 'SUCCEEDED' END AS status,
  c_custkey % 5 AS attempts, c_custkey % 4 AS budget_attempts, 1 + c_custkey % 10 AS max_attempts, c_custkey % 2 AS replay_count,
  CASE WHEN c_acctbal < 0 THEN c_mktsegment END AS last_error,
  CASE WHEN c_nationkey % 5 > 0 THEN CAST(c_custkey AS STRING) END AS workflow_run_id
FROM customer
"""

TEXTS["briefed_approvals"] = """
SELECT *, CASE WHEN iteration % 5 = 4 THEN 'no json' ELSE concat('{"summary":"version ', CAST(iteration AS STRING), '"}')
  END AS briefing_json FROM approval_rows
"""

TEXTS["run_configs"] = """
SELECT CAST(c_custkey AS STRING) AS run_id, CASE WHEN c_nationkey % 5 = 0 THEN '{"key":"order_id"}'
  ELSE concat('{"key":"order_id","max_human_revisions":', CAST(1 + c_nationkey % 4 AS STRING), '}') END AS config_json
FROM customer
"""

TEXTS["decision_log"] = f"""
SELECT event_id AS seq, concat(CAST(user_id AS STRING), '-', CAST(1 + {_K} % 4 AS STRING)) AS approval_id,
  CASE WHEN event_type IN ('error', 'click') THEN 'rejected' ELSE 'approved' END AS decision,
  CASE WHEN event_type = 'error' THEN ' ' WHEN event_type = 'click' THEN props END AS comment
FROM events
"""

TEXTS["approval_requests"] = """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn + 1 AS STRING)) AS approval_id,
  CAST(conv_id AS STRING) AS run_id, turn + 1 AS iteration, turn * 1200 AS requested_seq
FROM conversations
"""

# --- delivery ------------------------------------------------------------------

TEXTS["job_rows"] = """
SELECT concat('job_', CAST(o_orderkey AS STRING)) AS id, concat('evt_', CAST(o_orderkey AS STRING)) AS ingestion_id,
  left(@sha(CAST(o_orderkey AS STRING)), 32) AS workflow_run_id, kind AS status,
  CASE WHEN o_totalprice > 495000 THEN 150 ELSE o_custkey % 201 - 100 END AS priority,
  o_custkey % 5 AS attempts, o_custkey % 4 AS budget_attempts, o_custkey % 12 AS max_attempts,
  @stamp(@plus_seconds(o_orderdate, o_custkey % 10 * 86400)) AS available_at,
  CASE WHEN kind = 'LEASED' THEN 'worker' END AS lease_owner,
  CASE WHEN kind = 'LEASED' AND o_totalprice > 20000 OR o_totalprice < 3000 THEN @sha(o_orderpriority) END AS lease_token,
  CASE WHEN kind = 'LEASED' THEN @stamp(@plus_seconds(o_orderdate, 30)) END AS lease_expires_at,
  CASE WHEN kind = 'DEAD_LETTER' THEN 'failed' END AS last_error,
  CASE WHEN kind = 'DEAD_LETTER' THEN 'DeliveryFailure' END AS last_error_type,
  @stamp(o_orderdate) AS created_at, o_totalprice < 300000 AS replayable,
  o_custkey % 2 AS replay_count
FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'LEASED' WHEN '2-HIGH' THEN 'QUEUED'
  WHEN '3-MEDIUM' THEN 'WAITING_FOR_APPROVAL' WHEN '4-NOT SPECIFIED' THEN 'SUCCEEDED'
  ELSE CASE WHEN o_orderstatus = 'P' THEN 'QUEUED' ELSE 'DEAD_LETTER' END END AS kind FROM orders) AS kinds
"""

# The live log of a queue: who claimed, beat, failed or settled, and when. A row
# names the attempt it speaks for; a few speak for the one before.
TEXTS["delivery_log"] = f"""
SELECT event_id AS id, CAST(user_id AS STRING) AS job_id, ts AS at_time, {_K} AS k,
  CASE event_type WHEN 'signup' THEN 'replay' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'heartbeat'
    WHEN 'error' THEN 'fail' ELSE 'settle' END AS event,
  concat('worker-', CAST({_K} % 3 AS STRING)) AS worker_id,
  CASE WHEN {_K} % 10 = 0 AND event_type <> 'view' THEN 1 ELSE 0 END AS attempts_ago
FROM events
"""

TEXTS["failure_log"] = f"""
SELECT event_id AS id, CAST(user_id AS STRING) AS job_id, ts AS failed_at,
  event_type = 'signup' AS expired, event_type = 'click' AS busy, event_type = 'error' AND {_K} >= 90 AS terminal,
  {_K} % 9 AS budget_attempts, 1 + user_id % 8 AS max_attempts,
  CASE WHEN {_K} % 4 = 0 THEN {_K} ELSE CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 1
    ELSE CASE {_K} % 9 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 8 WHEN 5 THEN 16
      WHEN 6 THEN 32 ELSE 60 END END END AS delay_seconds,
  CASE WHEN {_K} % 7 = 0 THEN 'QUEUED' ELSE 'DEAD_LETTER' END AS status_after,
  CASE event_type WHEN 'signup' THEN 'EXPIRED' WHEN 'click' THEN 'DEFERRED' ELSE 'FAILED' END AS outcome
FROM events
"""

# The accepted history of each job, as the queue wrote it down.
TEXTS["job_log"] = f"""
SELECT event_id AS id, CAST(user_id AS STRING) AS job_id, @stamp(ts) AS logged_at,
  CASE event_type WHEN 'view' THEN 'job_claimed'
    WHEN 'signup' THEN CASE WHEN {_K} < 50 THEN 'job_created' ELSE 'job_replayed' END
    WHEN 'click' THEN CASE WHEN {_K} < 50 THEN 'job_deferred' ELSE 'job_requeued' END
    WHEN 'error' THEN CASE WHEN {_K} < 50 THEN 'job_failed' ELSE 'job_dead_lettered' END
    ELSE CASE WHEN {_K} < 50 THEN 'job_waiting_for_approval' ELSE 'job_succeeded' END END AS event,
  CASE WHEN event_type = 'error' THEN concat('error ', CAST({_K} AS STRING)) END AS error
FROM events
"""

TEXTS["enqueue_log"] = f"""
SELECT event_id AS seq, CAST(user_id AS STRING) AS ingestion_id, {_K} - 50 AS priority, 1 + {_K} % 10 AS max_attempts
FROM events
"""

def names_in(text: str) -> list[str]:
    """Derived tables a text reads, those they need first."""
    ordered: list[str] = []
    for word in re.findall(r"\b[a-z_]+\b", text):
        if word in TEXTS:
            for name in [*names_in(TEXTS[word]), word]:
                if name not in ordered:
                    ordered.append(name)
    return ordered


def with_definitions(sql: str) -> str:
    """The checking SQL with the derived tables it reads in front."""
    names = names_in(sql)
    body = spell(sql.strip(), CHECK)
    if not names:
        return body
    parts = [f"{name} AS ({spell(TEXTS[name].strip(), CHECK)})" for name in names]
    head = "WITH " + ",\n".join(parts)
    if body.upper().startswith("WITH "):
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"


_BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def spark_frame(tables, name: str) -> DataFrame:  # noqa: ANN001
    """A derived table as a DataFrame."""
    text = spell(TEXTS[name].strip(), SPARK)
    used = {
        word
        for word in re.findall(r"\b[a-z_]+\b", text)
        if (word in _BASE or word in TEXTS) and re.search(rf"\b(FROM|JOIN)\s+{word}\b", text)
    }
    marked = text.replace("{", "{{").replace("}", "}}")
    for word in used:
        marked = re.sub(rf"\b(FROM|JOIN)\s+{word}\b", rf"\1 {{{word}}}", marked)
    return tables.spark.sql(marked, **{word: tables[word] for word in used})
