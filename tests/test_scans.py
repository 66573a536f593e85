"""Text tables by their headers, dated files, sorted reports and forecast existence."""

from __future__ import annotations

from veriskill.operators import tracks
from veriskill.sources import readers, sinks


def test_named_rows(spark, tmp_path):
    (tmp_path / "k=1").mkdir()
    (tmp_path / "k=2").mkdir()
    wide = [f"c{k}" for k in range(240)]
    wide[239], wide[7] = "far", "near"
    (tmp_path / "k=1" / "a.csv").write_text(",".join(wide) + "\n" + ",".join(str(k) for k in range(240)) + "\n\n" + ",".join(wide) + "\n" + ",".join(["x"] * 200) + "\n")
    (tmp_path / "k=1" / "b.csv").write_text('﻿"far, away", far ,"say ""near""",near,near\n1,"a ""q"", b",3,,5\n1, "two, three" ,3,"",6\r\n"half,2,3,4\n')
    (tmp_path / "k=2" / "c.csv").write_text("other\n1\n")
    (tmp_path / "k=2" / "d.csv").write_text("")
    got = readers.named_rows(spark, str(tmp_path), ["near", "far", "k", "nowhere"])
    assert got.columns == ["k", "near", "far", "nowhere", "line"]
    rows = sorted(str((r.k, r.near, r.far, r.nowhere)) for r in got.collect())
    want = [(1, "7", "239", None), (1, "x", None, None), (1, None, 'a "q", b', None), (1, None, "two, three", None), (1, "4", "2", None), (2, None, None, None)]
    assert rows == sorted(map(str, want))


def test_named_rows_of_other_separators(spark, tmp_path):
    (tmp_path / "a.psv").write_text('b|a\n"1|2"|3\n4|\n')
    assert sorted(str(tuple(r)[:2]) for r in readers.named_rows(spark, str(tmp_path / "a.psv"), ["a", "b"], "|").collect()) == ["('3', '1|2')", "(None, '4')"]
    (tmp_path / "t.tsv").write_text("b\ta\n1\t2\n")
    assert [tuple(r)[:2] for r in readers.named_rows(spark, str(tmp_path / "t.tsv"), ["a", "b"], "\t").collect()] == [("2", "1")]


def test_long_quoted_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"' + 'x""' * 100_000 + '",2\n')
    row = readers.named_rows(spark, str(tmp_path / "a.csv"), ["a", "b"]).first()
    assert row.a == 'x"' * 100_000 and row.b == "2"


def test_concat_dated_reads_only_the_range(spark, tmp_path):
    for d in ("20240101", "20240102", "20240105"):
        spark.createDataFrame([(d, 1.0)], "name string, v double").coalesce(1).write.parquet(f"{tmp_path}/era5.t2m.{d}")
    found = readers.concat_dated(spark, str(tmp_path), "2024-01-02", "2024-01-05", pattern=r"\.(\d{8})/[^/]*$")
    assert sorted((r.name, str(r.day)) for r in found.collect()) == [("20240102", "2024-01-02"), ("20240105", "2024-01-05")]


def test_sorted_report(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id * 7919 % 5000 AS k", "id % 3 AS m")
    sinks.save_sorted(rows, f"{tmp_path}/r", ["m", "k"])
    lines = []
    for f in sorted((tmp_path / "r").glob("part-*.csv")):
        lines += [tuple(map(int, x.split(",")))[::-1] for x in f.read_text().split("\n")[1:] if x]
    assert lines == sorted(lines) and len(lines) == 5000


def test_forecast_existence(spark):
    inits = spark.createDataFrame([("m", "t1", 1), ("m", "t2", 1), ("n", "t1", 1), ("m", None, 2)], "model string, init_time string, sid int")
    catalog = spark.createDataFrame([("m", "t1", 6), ("m", "t1", 12), ("n", "t3", 6)], "model string, init_time string, lead_hours int")
    have, lost = tracks.with_forecast(inits, catalog)
    assert [tuple(r) for r in have.collect()] == [("m", "t1", 1)]
    assert sorted(str(tuple(r)) for r in lost.collect()) == sorted(str((*k, "missing_file", 0)) for k in (("m", "t2", 1), ("n", "t1", 1), ("m", None, 2)))
