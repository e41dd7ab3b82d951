"""Profiles kept between loads: what is read, and that the numbers are those of one pass."""

import os

import pytest

from corpuscat.operators.profile import numeric_summary
from corpuscat.operators.profile_store import stored_numeric_summary, update_profile


def test_only_new_files_are_read(spark, tmp_path):
    store, folder = str(tmp_path / "store"), tmp_path / "in"
    schema = "k bigint, v double, empty int, name string"
    asked = []

    def read(files):
        asked.append(len(files))
        return spark.read.schema(schema).parquet(*files)

    def add(low, high):
        rows = [(i, float(i * i % 997) if i % 5 else None, None, "x") for i in range(low, high)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))

    def files():
        return sorted(f"file:{folder}/{f}" for f in os.listdir(folder) if f.endswith(".parquet"))

    def check():
        got = {r["column"]: r for r in stored_numeric_summary(spark, files(), read, store).collect()}
        want = {r["column"]: r for r in numeric_summary(spark.read.schema(schema).parquet(str(folder))).collect()}
        assert got.keys() == want.keys() == {"k", "v", "empty"}
        for c, r in want.items():
            assert all(got[c][f] == (pytest.approx(r[f]) if r[f] is not None else None) for f in r.asDict() if f != "column")

    add(0, 3000)
    check()
    add(3000, 3700)
    asked.clear()
    assert update_profile(spark, files(), read, store)[1] == 1 and asked == [1]
    assert update_profile(spark, files(), read, store)[1] == 0
    check()
    # A file that is gone takes its load along, the other load stays.
    os.remove(files()[0].removeprefix("file:"))
    add(9000, 9001)
    assert update_profile(spark, files(), read, store)[1] == 1
    check()


def test_nothing_to_profile(spark, tmp_path):
    merged, n = update_profile(spark, [], lambda files: None, str(tmp_path / "store"))
    assert n == 0 and merged.count() == 0
