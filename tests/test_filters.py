import pytest
from pyspark.sql import functions as F

from corpuscat.operators import filters, frequency


def test_null_and_sentinel(spark):
    df = spark.createDataFrame([(None,), ("unknown",), ("drama",)], "Genre string")
    assert filters.exclude_value(df, "Genre", "unknown").count() == 2
    cast = spark.createDataFrame([(None,), (" ",), ("A",)], "Cast string")
    assert [r[0] for r in filters.keep_present(cast, "Cast").collect()] == ["A"]


def test_keep_first_equals_pandas(spark):
    rows = [(i, f"t{i % 7}" if i % 5 else None, i % 3 if i % 4 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id int, title string, year int").repartition(5)
    got = sorted(r["row_id"] for r in filters.keep_first(df, ["title", "year"], "row_id").collect())
    pdf = df.toPandas().sort_values("row_id")
    assert got == pdf.drop_duplicates(["title", "year"], keep="first")["row_id"].tolist()
    again = filters.keep_first(filters.keep_first(df, ["title", "year"], "row_id"), ["title", "year"], "row_id")
    assert again.count() == len(got)


def test_keep_first_moves_no_wide_rows(spark, plan_of):
    """Ids and digests are shuffled and stored beforehand; the rows themselves meet a short list where they are."""
    wide = spark.range(10).select("id", (F.col("id") % 3).cast("string").alias("k"), F.lit("text").alias("wide"))
    plan = plan_of(filters.keep_first(wide, ["k"], "id"))
    assert "LeftAnti" in plan and "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Sort" not in plan


def test_plans_stay_native(spark, plan_of, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", F.concat(F.lit("v"), F.col("id") % 5).alias("g"), F.lit("text").alias("wide")).write.parquet(path)
    df = spark.read.parquet(path)
    plan = plan_of(frequency.value_counts(df, "g", 3))
    assert "TakeOrderedAndProject" in plan and "ReadSchema: struct<g:string>" in plan
    plan = plan_of(frequency.keep_supported(df, "g", 3))
    assert "BroadcastHashJoin [g" in plan and "LeftSemi" in plan and "Python" not in plan
    assert "PushedFilters: [IsNotNull(g), Not(EqualTo(g,v1))]" in plan_of(df.filter("g != 'v1'"))
    assert "Not(EqualNullSafe(g,v1))" in plan_of(filters.exclude_value(df, "g", "v1"))


def test_head_and_repeats(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("c",), ("c",)], "t string")
    r = frequency.repeat_report(df, "t", 2).first()
    assert tuple(r) == (3, 1, 2, 3)


@pytest.mark.parametrize("max_bytes", [0, 1 << 26])
def test_keep_first_large_and_small(spark, max_bytes):
    """Null and empty keys, one key that a third of the rows have, and both ways out."""
    rows = [(i, None if i % 10 == 0 else "hot" if i % 3 == 0 else f"k{i % 40}", i % 2, "x" * 50) for i in range(300)]
    df = spark.createDataFrame(rows, "i bigint, k string, n int, t string").repartition(5)
    first = {}
    for r in sorted(rows):
        first.setdefault(r[1:3], r)
    got = filters.keep_first(df, ["k", "n"], "i", max_bytes=max_bytes)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(first.values())
    assert filters.keep_first(df.limit(0), ["k"], "i").count() == 0
