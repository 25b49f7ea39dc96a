"""Run registered queries in both engines and compare whole results.

    python tests/compare_all.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from tabwarden.plans import QUERIES, Tables  # noqa: E402
from tabwarden.plans.derived import _BASE  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    for name in _BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def differences(spark, con, folder: str, name: str) -> str | None:
    found = QUERIES[name]
    frame = found.run(Tables(spark, folder))
    rows = [row.asDict() for row in frame.collect()]
    if found.sql is None:
        return None
    result = con.execute(found.sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected = [dict(zip(columns, row, strict=True)) for row in result.fetchall()]
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    spark_kinds = dict(frame.dtypes)
    same = {"string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN", "int": "INTEGER", "double": "DOUBLE"}
    for column in columns:
        if same.get(spark_kinds[column]) != kinds[column]:
            return f"type of {column}: {spark_kinds[column]} != {kinds[column]}"
    names = sorted(columns)
    left = Counter(tuple(row[n] for n in names) for row in rows)
    right = Counter(tuple(row[n] for n in names) for row in expected)
    if left != right:
        extra, lacking = list((left - right).items())[:3], list((right - left).items())[:3]
        return f"rows {len(rows)} vs {len(expected)}\n  spark only {extra}\n  sql only {lacking}"[:3000]
    return None if rows else "empty result"


def main() -> None:
    from tabwarden.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark, con = local_session(), connect(folder)
    bad = 0
    for name in QUERIES:
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            problem = differences(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        kind = "S" if QUERIES[name].sql else "R"
        print(f"{'FAIL' if problem else 'ok'} {kind} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
