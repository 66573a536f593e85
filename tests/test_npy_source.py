"""The NPY source: pushed filters choose folders, files and rows."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

from veriskill.sources import npy_source, readers


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("npy")
    rng = np.random.default_rng(1)
    for day in ("2023-12-31", "2024-01-01", "2024-01-02", "2024-02-01"):
        d = root / "era5" / day[:4] / day
        d.mkdir(parents=True)
        for h in ("00:00:00", "06-00-00"):
            for channel in ("z-500", "z-850.0", "t2m"):
                field = rng.random((5, 4)).astype(np.float32 if channel != "t2m" else np.float64)
                field[1, 2] = np.nan
                np.save(d / f"{h}-{channel}.npy", np.asfortranarray(field) if channel == "z-500" and h[0:2] == "06" else field)
        (d / "readme.txt").write_text("x")
    return str(root)


def rows(df):
    return sorted(str((str(r.valid_time), r.variable, r.level_hpa, r.lat_i, r.vals)) for r in df.collect())


@pytest.mark.parametrize("flip", [False, True])
def test_equals_the_plain_scan(spark, tree, flip):
    got, plain = npy_source.npy_table(spark, tree, "era5", flip), readers.npy_fields(spark, tree, "era5", flip)
    assert got.columns == plain.columns and rows(got) == rows(plain) and len(rows(got)) == 4 * 2 * 3 * 5
    some = (F.col("valid_time") >= "2024-01-01") & (F.col("valid_time") < "2024-02-01 06:00:00") & F.col("variable").isin("z", "t2m") & F.col("lat_i").between(1, 3)
    assert rows(got.where(some)) == rows(plain.where(some)) and len(rows(got.where(some))) == 5 * 3 * 3
    level = (F.col("level_hpa") == 500) & (F.col("lat_i") == 4)
    assert rows(got.where(level)) == rows(plain.where(level)) and got.where("level_hpa IS NULL").count() == 40
    assert got.where("variable = 'none'").count() == 0


def test_filters_choose_what_is_read(tree):
    reader = npy_source.NpyReader(tree, False)
    at = lambda *x: dt.datetime(*x, tzinfo=dt.timezone.utc)
    left = IsNotNull(("variable",))
    back = [*reader.pushFilters([left, GreaterThanOrEqual(("valid_time",), at(2024, 1, 1)), LessThan(("valid_time",), at(2024, 1, 2, 6)), In(("variable",), ("z",)), EqualTo(("level_hpa",), 850), EqualTo(("lat_i",), 2)])]
    assert back == [left]
    listed = []
    real = npy_source.NpyReader._folders

    def spy(self, fs, folder):
        listed.append(folder.rpartition("/")[2])
        return real(self, fs, folder)

    npy_source.NpyReader._folders = spy
    try:
        parts = reader.partitions()
    finally:
        npy_source.NpyReader._folders = real
    assert [f[1:] for p in parts for f in p.files] == [(at(2024, 1, 1), "z", 850), (at(2024, 1, 1, 6), "z", 850), (at(2024, 1, 2), "z", 850)]
    assert "2023" not in listed and "2024-02-01" not in listed and {"2024-01-01", "2024-01-02"} <= set(listed)
    assert [b.num_rows for p in parts for b in reader.read(p)] == [1, 1, 1]


def test_a_plan_shows_the_pushed_filters(spark, tree, capsys):
    npy_source.npy_table(spark, tree, "era5").where("variable = 'z' AND lat_i < 2").explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "EqualTo(variable,z)" in plan and "LessThan(lat_i,2)" in plan


def test_fields_of_three_dimensions_fail(spark, tmp_path):
    (tmp_path / "2024" / "2024-01-01").mkdir(parents=True)
    np.save(tmp_path / "2024" / "2024-01-01" / "00:00:00-z-500.npy", np.zeros((2, 3, 4)))
    with pytest.raises(Exception, match="dimensions"):
        npy_source.npy_table(spark, str(tmp_path), "era5").collect()
