import pytest
from pyspark.sql import functions as F

from corpuscat.operators import frequency, labels, profile, scale
from corpuscat.operators.frequency import frequencies
from corpuscat.operators.scale import lookup, rank_all, total_before
from corpuscat.session import cut_lineage


@pytest.fixture(scope="module")
def skewed(spark):
    # one key holds a third of the rows, some rows have none, some keys are not in the table
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 400).cast("string")))
    return spark.range(6000).select("id", key.alias("key"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("max_bytes", [0, 800, 10_000, 1 << 26])
@pytest.mark.parametrize("absent", [("k7", "k8"), ("hot", "k7")])
def test_lookup_equals_plain_join(spark, skewed, how, max_bytes, absent):
    counts = frequencies(skewed, "key").filter(~F.col("value").isin(*absent))
    table = cut_lineage(counts.select(F.col("value").alias("key"), "n", F.length("value").alias("w")))
    got = lookup(skewed, table, "key", "n", how, max_bytes=max_bytes)
    want = skewed.join(table.drop("n"), "key", how).select(*got.columns)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


@pytest.mark.parametrize("how,absent", [("inner", ""), ("left", ""), ("left", "hot")])
def test_hot_keys_with_wide_rows_are_dealt_out(spark, skewed, plan_of, how, absent):
    """The hot key's row is wider than any other; its many rows still come to many tasks."""
    wide = F.when(F.col("value") == "hot", F.sequence(F.lit(1), F.lit(3_000))).otherwise(F.array(F.lit(1)))
    counts = frequencies(skewed, "key").filter(F.col("value") != absent)
    table = cut_lineage(counts.select(F.col("value").alias("key"), "n", wide.alias("w")))
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = lookup(skewed, table, "key", "n", how, max_bytes=0)
        assert "SortMergeJoin" in plan_of(joined) or "ShuffledHashJoin" in plan_of(joined)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == (6000 if how == "left" else 6000 - skewed.filter("key is null").count())
    assert len(sizes) >= 12 and max(sizes) < 2.5 * 6000 / 16


def test_rank_all(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), (F.col("id") % 13).alias("g")).repartition(7)
    got = {(r["g"], r["v"]): r["i"] for r in rank_all(df, [F.desc("g"), F.col("v")], "i", start=4).collect()}
    order = sorted(got, key=lambda k: (-k[0], k[1]))
    assert [got[k] for k in order] == list(range(4, 5004))
    assert rank_all(df.limit(0), [F.col("v")], "i").count() == 0


def test_total_before(spark):
    df = spark.range(3000).select((F.col("id") * 7 % 3000).alias("v"), (F.col("id") % 5).alias("s")).repartition(6)
    rows = total_before(df, [F.col("v")], "s", "b").orderBy("v").collect()
    total = 0
    for r in rows:
        assert r["b"] == total
        total += r["s"]


def test_quantiles_by_sorting_equal_percentile(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 501).cast("double").alias("a"), F.when(F.col("id") % 4 > 0, F.sqrt("id")).alias("b"), F.lit(None).cast("int").alias("c"))
    few = profile.numeric_summary(df).orderBy("column").collect()
    many = profile.numeric_summary(df, margin=0.0001).orderBy("column").collect()
    pdf = df.toPandas().astype(float).describe()
    for a, b in zip(few, many):
        assert a["n"] == b["n"]
        for c in ("p25", "p50", "p75"):
            assert a[c] == pytest.approx(b[c]) if a[c] is not None else b[c] is None
    for r in few[:2]:
        assert r["std"] == pytest.approx(pdf[r["column"]]["std"])
        assert r["p25"] == pytest.approx(pdf[r["column"]]["25%"])


def test_long_element_and_label_lists(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, ["c"]), (4, [])], "i int, l array<string>")
    want = [(1, ["a", "b", "a"]), (2, ["b"])]
    for limit in (2000, 0):
        monkeypatch.setattr(frequency, "bounded_rows", lambda d, n=limit: scale.bounded_rows(d, n))
        monkeypatch.setattr(labels, "bounded_rows", lambda d, n=limit: scale.bounded_rows(d, n))
        kept = frequency.keep_supported_elements(df, "i", "l", 2, "k")
        assert sorted((r["i"], r["k"]) for r in kept.collect()) == want
        index = {r["category"]: r["label"] for r in labels.element_index(df, "l").collect()}
        assert index == {"a": 0, "b": 1, "c": 2}


def test_wide_value_is_not_a_literal(spark):
    df = spark.createDataFrame([("x" * 5000,), ("y",)], "v string")
    assert scale.bounded_rows(df) is None
    assert len(scale.bounded_rows(df.filter("v = 'y'"))) == 1


def test_support_bounds(spark):
    rows = [("a",)] * 51 + [("b",)] * 50 + [(None,)] * 60
    df = spark.createDataFrame(rows, "g string")
    assert {r["g"] for r in frequency.keep_supported(df, "g", 50).collect()} == {"a"}
    lists = spark.createDataFrame([(["p"],)] * 9 + [(["q"],)] * 10, "l array<string>")
    assert [r["value"] for r in frequency.supported_elements(lists, "l", 10).collect()] == ["q"]


def test_tie_at_the_last_rank(spark):
    df = spark.createDataFrame([("b",), ("a",)], "g string")
    assert frequency.top_values(df, "g", 1) == ["a"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("complete", [True, False])
def test_heaviest_keys_of_a_large_table_stay_where_they_are(spark, plan_of, how, complete):
    """Of a table beyond the bound the keys with most rows are broadcast; only the other rows are dealt."""
    key = F.concat(F.lit("k"), F.floor(F.exp(F.col("id") % 1000 / 1000 * 7)).cast("string"))
    rows = cut_lineage(spark.range(8000).select("id", F.when(F.col("id") % 97 > 0, key).alias("key")))
    counts = frequencies(rows, "key").withColumnRenamed("value", "key")
    table = cut_lineage((counts if complete else counts.filter("n <> 16")).withColumn("w", F.length("key")))
    bytes_ = table.agg(F.sum(scale.row_bytes(table.select("key", "w")))).first()[0]
    small, least = scale.heaviest(table, "n", scale.row_bytes(table.select("key", "w")), bytes_ // 3)
    head = table.filter(F.col("n") >= least)
    assert not small and head.agg(F.sum(scale.row_bytes(head.select("key", "w")))).first()[0] <= bytes_ // 3
    got = lookup(rows, table, "key", "n", how, max_bytes=bytes_ // 3, complete=complete)
    want = rows.join(table.drop("n"), "key", how).select(*got.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert "left_anti" in got._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftanti", "left_anti")


def test_row_bytes_of_lists_of_lists(spark):
    df = spark.range(2).select(F.array(F.struct(F.lit(1).alias("b"), F.sequence(F.lit(1), F.lit(1000)).alias("g"))).alias("a"))
    assert df.agg(F.min(scale.row_bytes(df))).first()[0] >= 8000


def test_heaviest_without_heavy_keys(spark):
    table = spark.range(500).select(F.col("id").alias("key"), F.lit(1).alias("n"), F.lit("x").alias("w"))
    assert scale.heaviest(table, "n", scale.row_bytes(table), 1000) == (False, None)
    assert scale.heaviest(table.limit(0), "n", scale.row_bytes(table), 0) == (True, None)
