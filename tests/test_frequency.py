from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuscat.operators import frequency


def brute(values, n):
    counts = Counter(v for v in values if v is not None)
    return sorted(counts.items(), key=lambda e: (-e[1], e[0].encode()))[:n]


def listed(df):
    return [(r["value"], r["n"]) for r in df.collect()]


VALUES = [f"rare {i}" for i in range(4_000)] + [f"some {i % 60}" for i in range(900)] + [f"often {i}" for i in range(8) for _ in range(30 + i)] + [None] * 50


@pytest.mark.parametrize("buckets", [1, 7, 1 << 12, frequency.BUCKETS])
@pytest.mark.parametrize("n", [1, 8, 20, 10_000])
def test_top_of_rare_is_the_exact_list(spark, buckets, n):
    df = spark.createDataFrame([(v, 1) for v in VALUES], "t string, value int").repartition(5)
    assert listed(frequency.top_of_rare(df, "t", n, buckets)) == brute(VALUES, n)


def test_rare_values_are_left_out_before_the_count(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "t string")
    held = frequency.possible_top(df, "t", 8)
    assert held.count() < 400  # of 5,168: the 268 that are often there, and what shares a bucket with them
    assert {v for v, _ in brute(VALUES, 8)} <= {r[0] for r in held.distinct().collect()}


def test_one_heavy_value_and_ties(spark):
    values = ["a"] * 500 + ["b", "c", "d", ""]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    assert listed(frequency.top_of_rare(df, "t", 3)) == [("a", 500), ("", 1), ("b", 1)]


def test_no_values(spark):
    for df in (spark.createDataFrame([], "t string"), spark.createDataFrame([(None,)], "t string")):
        assert listed(frequency.top_of_rare(df, "t", 5)) == []
    with pytest.raises(ValueError):
        frequency.top_of_rare(df, "t", 0)


def test_charts_from_one_scan(spark, plan_of, tmp_path):
    rows = [("x", 1), ("x", 2), ("y", 2), (None, 2), ("z", None), ("y", 1)]
    spark.createDataFrame(rows, "a string, b int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = frequency.top_charts(df, {"as": (F.col("a"), 2), "bs": (F.col("b"), 5), "none": (F.lit(None).cast("string"), 3)})
    assert sorted(map(tuple, out.collect())) == [("as", 1, "x", 2), ("as", 2, "y", 2), ("bs", 1, "2", 3), ("bs", 2, "1", 2)]
    plan = plan_of(out).split("Initial Plan")[-1]
    assert plan.count("FileScan") == 1 and plan.count("WindowGroupLimit") >= 1
