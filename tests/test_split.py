import math

import pytest
from pyspark.sql import functions as F

from corpuscat.operators import split


def labelled(spark, counts):
    rows = [(f"{c}-{i}", c) for c, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, label string")


@pytest.mark.parametrize("plan", [split.SPLIT_64_16_20, split.SPLIT_80_10_10])
@pytest.mark.parametrize("class_limit", [2000, 0])
def test_sizes_and_strata(spark, plan, class_limit):
    counts = {"a": 700, "b": 301, "c": 57, "d": 23}
    df = labelled(spark, counts)
    parts = split.stratified_split(df, "label", "id", plan, class_limit=class_limit)
    n = {(r["split"], r["label"]): r["n"] for r in split.split_sizes(parts, "label").collect()}
    total = sum(counts.values())
    held = math.ceil(total * 0.2)
    sizes = {p: sum(v for (q, _), v in n.items() if q == p) for p in split.PARTS}
    if plan == split.SPLIT_64_16_20:
        val = math.ceil((total - held) * 0.2)
        assert sizes == {"test": held, "val": val, "train": total - held - val}
    else:
        test = math.ceil(held * 0.5)
        assert sizes == {"test": test, "val": held - test, "train": total - held}
    for c, k in counts.items():
        assert sum(n[p, c] for p in split.PARTS) == k
        if plan == split.SPLIT_64_16_20:
            assert abs(n["test", c] - k * held / total) < 1


def test_same_rows_after_repartition_and_on_both_routes(spark):
    df = labelled(spark, {"a": 400, "b": 150, "c": 31})
    runs = [
        split.split_64_16_20(df, "label", "id"),
        split.split_64_16_20(df.repartition(7), "label", "id"),
        split.stratified_split(df.repartition(3), "label", "id", split.SPLIT_64_16_20, class_limit=0),
    ]
    first = {tuple(r) for r in runs[0].collect()}
    assert all({tuple(r) for r in run.collect()} == first for run in runs[1:])
    other = {tuple(r) for r in split.split_64_16_20(df, "label", "id", seed=7).collect()}
    assert other != first


def test_order_inside_a_class_is_the_hash_order(spark):
    df = labelled(spark, {"a": 500, "b": 20})
    parts = split.split_64_16_20(df, "label", "id").withColumn("h", F.md5(F.concat(F.lit("42:"), "id")))
    rows = [r for r in parts.filter("label = 'a'").orderBy("h", "id").collect()]
    names = [r["split"] for r in rows]
    assert names == sorted(names, key=["test", "val", "train"].index)


def test_quota_by_largest_remainder():
    assert split.listed_shares({"a": 7, "b": 3}, 20) == {"a": 1, "b": 1}
    assert split.listed_shares({0: 5, 1: 5}, 50) == {0: 3, 1: 2}


def test_small_class_is_an_error(spark):
    for limit in (2000, 0):
        with pytest.raises(ValueError, match="'b'"):
            split.stratified_split(labelled(spark, {"a": 30, "b": 1}), "label", "id", split.SPLIT_64_16_20, class_limit=limit)
    with pytest.raises(ValueError, match="no label"):
        split.split_64_16_20(spark.createDataFrame([("x", None), ("y", "a"), ("z", "a")], "id string, label string"), "label", "id")


@pytest.mark.parametrize("plan", [split.SPLIT_64_16_20, split.SPLIT_80_10_10])
@pytest.mark.parametrize("class_limit", [2000, 0])
def test_later_rows_keep_the_shares(spark, plan, class_limit):
    shares = {split.SPLIT_64_16_20: (0.2, 0.16), split.SPLIT_80_10_10: (0.1, 0.1)}[plan]
    first = split.stratified_split(labelled(spark, {"a": 400, "b": 151, "c": 33}), "label", "id", plan)
    counts = split.part_counts(first, "label")
    done = {("a", 400), ("b", 151), ("c", 33)}
    for step, more in enumerate([{"a": 57, "b": 3, "d": 1}, {"a": 1, "c": 90, "d": 40}, {"d": 1, "b": 210}]):
        rows = labelled(spark, more).withColumn("id", F.concat(F.lit(f"{step}/"), "id"))
        parts, counts = split.split_later(rows, counts, "label", "id", plan, class_limit=class_limit)
        assert parts.count() == sum(more.values())
        done |= {(f"{c}{step}", n) for c, n in more.items()}
        for r in counts.collect():
            assert r["n"] == sum(n for c, n in done if c[0] == r["label"])
            assert abs(r["test"] - shares[0] * r["n"]) <= 1 and abs(r["val"] - shares[1] * r["n"]) <= 2


def test_later_rows_of_one_batch_follow_the_hash(spark):
    counts = split.part_counts(split.split_64_16_20(labelled(spark, {"a": 50}), "label", "id"), "label")
    rows = labelled(spark, {"a": 300}).withColumn("id", F.concat(F.lit("x"), "id"))
    parts, total = split.split_later(rows, counts, "label", "id", split.SPLIT_64_16_20)
    names = [r["split"] for r in parts.orderBy(F.md5(F.concat(F.lit("42:"), "id"))).collect()]
    assert names == sorted(names, key=["test", "val", "train"].index)
    assert tuple(total.first()) == ("a", 350, 70, 56)
    nothing, same = split.split_later(rows.limit(0), total, "label", "id", split.SPLIT_64_16_20)
    assert nothing.count() == 0 and [tuple(r) for r in same.collect()] == [("a", 350, 70, 56)]
    with pytest.raises(ValueError, match="no label"):
        split.split_later(rows.withColumn("label", F.lit(None).cast("string")), total, "label", "id", split.SPLIT_64_16_20)
