from __future__ import annotations

import random

import pytest

from tabwarden.operators import comparison as c


def _snapshot(spark, header, rows):
    schema = ", ".join(["record_no bigint", *[f"`{name}` string" for name in header]])
    return spark.createDataFrame([(n, *row) for n, row in enumerate(rows, 2)], schema)


def _findings(result):
    return [(r.kind, r.key, r.fields) for r in result.findings.collect()]


def test_kinds_fields_and_counts(spark):
    before = _snapshot(spark, ("k", "v", "w"), [("a", "1", "x"), ("b", "1", "x"), ("c", "1", "x")])
    after = _snapshot(spark, ("w", "k", "v"), [("x", " b", "1.0"), ("x", "d", "1"), ("x", "a ", "1")])
    result = c.compare(before, after, "k")
    assert _findings(result) == [("changed", "b", ["v"]), ("removed", "c", ["v", "w"]), ("added", "d", ["v", "w"])]
    row = result.summary.first().asDict()
    assert [row[n] for n in ("before_rows", "after_rows", "added", "removed", "changed", "unchanged", "total_changes")] == [3, 3, 1, 1, 1, 1, 3]
    assert row["status"] == "changed"
    images = {r.key: (r.before, r.after) for r in result.findings.collect()}
    assert images["d"] == (None, {"w": "x", "k": "d", "v": "1"})
    assert images["b"][1]["k"] == " b"
    assert {(r.key, r.field, r.before, r.after) for r in result.cells.collect()} >= {("b", "v", "1", "1.0"), ("c", "w", "x", None)}


def test_schema_change_alone_and_empty_snapshots(spark):
    before, after = _snapshot(spark, ("k", "old"), [("a", "1")]), _snapshot(spark, ("k", "new"), [("a", "2")])
    result = c.compare(before, after, "k")
    assert (result.summary.first().status, result.summary.first().total_changes) == ("changed", 0)
    assert {(r.change, r.column) for r in result.schema_diff.collect()} == {("added", "new"), ("removed", "old")}
    empty = _snapshot(spark, ("k",), [])
    assert c.compare(empty, empty, "k").summary.first().status == "unchanged"


def test_null_is_not_blank_but_equals_null(spark):
    before, after = _snapshot(spark, ("k", "v"), [("a", None), ("b", None)]), _snapshot(spark, ("k", "v"), [("a", ""), ("b", None)])
    assert _findings(c.compare(before, after, "k")) == [("changed", "a", ["v"])]


def test_key_only_record_has_one_cell_row(spark):
    before, after = _snapshot(spark, ("k",), [("a",)]), _snapshot(spark, ("k",), [("b",)])
    rows = c.cell_changes(before, after, "k").collect()
    assert sorted((r.key, r.kind, r.field) for r in rows) == [("a", "removed", None), ("b", "added", None)]


@pytest.mark.parametrize(
    ("before", "after", "key", "text"),
    [
        ([("a",)], [("a",)], "zz", "missing"),
        ([("a",)], [("a",)], " ", "nonblank"),
        ([("a",), (" ",)], [("a",)], "k", "before, record 3: key 'k' is blank"),
        ([("a",)], [("b",), ("c",), ("c ",), ("b",)], "k", "after, record 4: key 'k' is duplicate"),
        ([("a",), ("a",), ("",)], [("",)], "k", "before, record 3: key 'k' is duplicate"),
    ],
)
def test_bad_keys_are_refused(spark, before, after, key, text):
    with pytest.raises(c.KeyContractError, match=text):
        c.compare(_snapshot(spark, ("k",), before), _snapshot(spark, ("k",), after), key)


@pytest.mark.parametrize("cap", [0, 1])
def test_cap(spark, cap):
    before, after = _snapshot(spark, ("k",), [("b",), ("é",)]), _snapshot(spark, ("k",), [("Z",)])
    result = c.compare(before, after, "k", max_findings=cap)
    assert [f[1] for f in _findings(result)] == ["Z", "b", "é"][:cap]
    assert (result.summary.first().total_changes, result.summary.first().reported_findings) == (3, cap)


@pytest.mark.parametrize("seed", [4, 5])
def test_random_snapshots_agree_with_row_loop(spark, seed):
    rng = random.Random(seed)

    def side(header):
        keys = rng.sample(range(60), 40)
        return {str(k): {h: rng.choice(["x", "y", "", "x "]) for h in header} for k in keys}

    old_header, new_header = ["p", "q", "r"], ["q", "s", "p"]
    old, new = side(old_header), side(new_header)
    frames = [
        _snapshot(spark, ["k", *header], [(rng.choice(["", " "]) + k, *[row[h] for h in header]) for k, row in data.items()])
        for header, data in ((old_header, old), (new_header, new))
    ]
    expected = []
    for key in sorted(old.keys() | new.keys()):
        if key not in old:
            expected.append(("added", key, sorted(new_header)))
        elif key not in new:
            expected.append(("removed", key, sorted(old_header)))
        else:
            fields = [f for f in ("p", "q") if old[key][f] != new[key][f]]
            expected += [("changed", key, fields)] if fields else []
    assert _findings(c.compare(*frames, "k")) == expected
    assert sorted(r.key for r in c.unchanged_rows(*frames, "k").collect()) == sorted((old.keys() & new.keys()) - {k for _, k, _ in expected})
    assert sorted(r.key for r in c.added_rows(*frames, "k").collect()) == sorted(new.keys() - old.keys())
    assert sorted(r.key for r in c.removed_rows(*frames, "k").collect()) == sorted(old.keys() - new.keys())
