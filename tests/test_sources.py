from __future__ import annotations

import csv
import random

import pytest

from tabwarden.functions.dataset import header
from tabwarden.sources import delimited as d
from tabwarden.sources import records, sinks
from tabwarden.sources.inbox import inbox_scan, source_listing


def _file(tmp_path, content, name="export.csv"):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def _records(ds):
    names = header(ds)
    return [tuple(row[n] for n in ("record_no", *names)) for row in ds.orderBy("record_no").collect()]


def test_cells_keep_their_text(spark, tmp_path):
    path = _file(tmp_path, '﻿id,note\n1," a, ""b""\nc "\n2,\n3,""\n 4 ,é\n')
    assert _records(d.read_export(spark, path)) == [
        (2, "1", ' a, "b"\nc '), (3, "2", ""), (4, "3", ""), (5, " 4 ", "é"),
    ]


def test_header_only_and_other_delimiter(spark, tmp_path):
    assert _records(d.read_export(spark, _file(tmp_path, "a;b\n", "h.csv"), ";")) == []
    assert _records(d.read_export(spark, _file(tmp_path, "a|b\nx,y|z\n", "p.csv"), "|")) == [(2, "x,y", "z")]


def test_long_field(spark, tmp_path):
    (row,) = _records(d.read_export(spark, _file(tmp_path, "a,b\n" + "z" * 200_000 + ",1\n")))
    assert len(row[1]) == 200_000


@pytest.mark.parametrize(
    ("content", "text"),
    [
        ("", "no_header"),
        ("a, ,c\n1,2,3\n", "blank_header"),
        ("a,b,a\n1,2,3\n", "duplicate_header"),
        ("a,b\n1\n", "wrong field count"),
        ("a,b\n1,2,3\n", "wrong field count"),
        ("a,b\n1,2\n\n3,4\n", "blank_line"),
        ('a,b\n1,"x"y\n', "stray_quote"),
        ('a,b\n1,"open\n', "stray_quote"),
        (b"a,b\n1,\xff\n", "not_utf8"),
    ],
)
def test_ambiguous_exports_are_refused(spark, tmp_path, content, text):
    with pytest.raises(d.ExportError, match=text):
        d.read_export(spark, _file(tmp_path, content))


@pytest.mark.parametrize("delimiter", ["", ",,", '"', "\n", "\0"])
def test_bad_delimiters(spark, delimiter):
    with pytest.raises(d.ExportError):
        d.read_export(spark, "nowhere", delimiter)


def test_quarantine_keeps_good_records_and_their_numbers(spark, tmp_path):
    scanned = d.scan_export(spark, _file(tmp_path, "a,b\n1,2\n3\n4,5\n"))
    good, bad = d.structure_quarantine(scanned)
    assert _records(good) == [(2, "1", "2"), (4, "4", "5")]
    assert [(r.record_no, r.raw) for r in bad.collect()] == [(3, "3")]


def test_record_numbers_over_many_blocks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for name in ("x.csv", "y.csv"):
            _file(tmp_path, "id,v\n" + "".join(f"{n},{name}\n" for n in range(1500)), name)
        ds = d.read_export(spark, str(tmp_path), multi_line=False)
        assert ds.rdd.getNumPartitions() > 2
        rows = ds.selectExpr("v", "cast(id as bigint) + 2 = record_no AS ok").groupBy("v", "ok").count().collect()
        assert sorted((r.v, r.ok, r["count"]) for r in rows) == [("x.csv", True, 1500), ("y.csv", True, 1500)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_inbox_is_flat_sorted_and_isolates_large_files(spark, tmp_path):
    _file(tmp_path, "{}", "b.job.json")
    _file(tmp_path, b" " * (64 * 1024 + 1), "a.job.json")
    _file(tmp_path, "{}", "other.json")
    (tmp_path / "deep").mkdir()
    _file(tmp_path / "deep", "{}", "c.job.json")
    rows = inbox_scan(spark, str(tmp_path), ".job.json").collect()
    assert [(r.file_name, r.fits) for r in rows] == [("a.job.json", False), ("b.job.json", True)]
    assert source_listing(spark, str(tmp_path)).count() == 4


def test_documents_are_files_of_one_row(spark, tmp_path):
    folder = tmp_path / "in"
    sinks.write_documents(spark.range(300).selectExpr("id", "CASE WHEN id > 5 THEN 'é' END AS t"), str(folder))
    texts = [p.read_text() for p in folder.iterdir() if p.suffix == ".json"]
    assert sorted(texts) == sorted(f'{{"id":{n}' + (',"t":"é"' if n > 5 else "") + "}\n" for n in range(300))
    assert not list(folder.glob(".*.json.crc")) and not (folder / "_temporary").exists()


def test_results_refuse_numbers_json_lacks(spark, tmp_path):
    good = spark.createDataFrame([("é", 1.5, None)], "t string, x double, y string")
    sinks.write_result({"good": good}, str(tmp_path))
    assert '{"t":"é","x":1.5,"y":null}' in "".join(p.read_text() for p in (tmp_path / "good").glob("*.json"))
    with pytest.raises(Exception, match="not a finite number"):
        sinks.write_result({"bad": spark.createDataFrame([(float("nan"),)], "x double")}, str(tmp_path))


def test_repeated_batch_is_not_doubled(spark, tmp_path):
    rows = spark.range(5)
    for batch in (0, 1, 1):
        sinks.append_history(rows, str(tmp_path / "log"), batch)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 10


def _table(rng, rows):
    cell = lambda: "".join(rng.choice(["a", "é", '"', ",", "\n", " ", "\n\n", '""', "x" * 30]) for _ in range(rng.randrange(6)))
    return [[str(n), cell(), cell() or "z"] for n in range(rows)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_multi_line_files_are_read_in_splits(spark, tmp_path, end):
    """Every way to cut the files gives the records that the csv module reads."""
    rng = random.Random(len(end))
    for name in ("one.csv", "two.csv"):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as out:
            csv.writer(out, lineterminator=end).writerows([["id", "a", "b"], *_table(rng, 150)])
    want = {}
    for name in ("one.csv", "two.csv"):
        with open(tmp_path / name, newline="", encoding="utf-8") as file:
            want[name] = [(n, *row) for n, row in enumerate(csv.reader(file), 1)][1:]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in (37, 400, 100_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            got = {"one.csv": [], "two.csv": []}
            for strict in (True, False) if size == 400 else (True,):
                rows = d.read_export(spark, str(tmp_path), strict=strict).orderBy("record_no").collect()
                for r in rows:
                    got[r[d.SOURCE_FILE].rsplit("/", 1)[-1]].append((r.record_no, r.id, r.a, r.b))
                assert got == want
                got = {"one.csv": [], "two.csv": []}
        spark.conf.set("spark.sql.files.maxPartitionBytes", 400)
        tasks = records.lines(spark, str(tmp_path / "one.csv"), ",").rdd.getNumPartitions()
        assert tasks >= 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


@pytest.mark.parametrize(
    ("content", "text"),
    [
        ('a,b\n1,"x\ny"\n2\n3,4,5\n', "record 3: wrong field count"),
        ('a,b\n1,"x\n\ny"\n2,3\n4,"5"6\n7\n', "stray_quote .*record 4"),
        ('a,b\n1,"x\ny"\n\n\n2\n', "blank_line .*record 3"),
    ],
)
def test_the_first_bad_record_is_named(spark, tmp_path, content, text):
    with pytest.raises(d.ExportError, match=text):
        d.read_export(spark, _file(tmp_path, content))


def test_other_headers_and_line_ends_in_quotes(spark, tmp_path):
    _file(tmp_path, "a,b\n1,2\n", "one.csv")
    _file(tmp_path, "b,a\n1,2\n", "two.csv")
    with pytest.raises(d.ExportError, match="other_header .*two.csv, record 1"):
        d.read_export(spark, str(tmp_path))
    path = _file(tmp_path, 'a,b\r\n1,"x\r\ny"\r\n,\r\n', "crlf.csv")
    assert _records(d.read_export(spark, path)) == [(2, "1", "x\r\ny"), (3, "", "")]
