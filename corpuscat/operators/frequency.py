"""Frequency tables, top lists, minimum support, repeated values, chart series.

Ties are broken by value, so that every list has one right order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscat.operators.scale import bounded_rows, lookup, rank_all
from corpuscat.session import cut_lineage

BUCKETS = 1 << 18  # of hashes, for top lists over mostly rare values; 16 bytes each where they are broadcast


def frequencies(df: DataFrame, col: str) -> DataFrame:
    """``(value, n)`` of the non-null values."""
    value = F.col(f"`{col}`")
    return df.select(value.alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Frequencies, most frequent first; with ``n`` only the first ``n``."""
    ordered = frequencies(df, col).orderBy(F.desc("n"), "value")
    return ordered if n is None else ordered.limit(n)


def possible_top(df: DataFrame, col: str, n: int, buckets: int = BUCKETS) -> DataFrame:
    """The non-null values of ``col``, one row for each occurrence, without those that cannot be in the top ``n``.

    A bucket of hashes has at least as many rows as each of its values. The values of the
    ``n`` fullest buckets are counted exactly, and the n-th highest of those counts is a
    floor for the list: values of buckets below it are out. Buckets are counted within
    tasks first, so a pass moves at most ``buckets`` numbers a task and no value that is out.
    """
    if n < 1:
        raise ValueError("a top list needs a length")
    value = F.col(f"`{col}`")
    given = df.select(value.alias("value")).filter("value is not null").withColumn("_bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int"))
    sizes = cut_lineage(given.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size")))
    fullest = sizes.orderBy(F.desc("_size"), "_bucket").limit(n).select("_bucket")
    counted = frequencies(given.join(F.broadcast(fullest), "_bucket", "left_semi"), "value")
    floor = counted.orderBy(F.desc("n")).limit(n).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("floor")).first()
    # Fewer values than asked for in the n fullest buckets: those are all buckets there are.
    open_ = sizes.filter(F.col("_size") >= (floor["floor"] if floor["k"] == n else 0)).select("_bucket")
    return given.join(F.broadcast(open_), "_bucket", "left_semi").select("value")


def top_of_rare(df: DataFrame, col: str, n: int, buckets: int = BUCKETS) -> DataFrame:
    """``value_counts`` with ``n`` for a column of wide or mostly rare values, whole texts for one.

    The list is the exact one. Two more passes over the column save the shuffle of every
    value that ``possible_top`` rules out; with even counts it rules out nothing.
    """
    return value_counts(possible_top(df, col, n, buckets), "value", n)


def key_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequencies in key order, as for a series over years."""
    return frequencies(df, col).orderBy("value")


def top_values(df: DataFrame, col: str, n: int = 25) -> list[str]:
    """The ``n`` most frequent values, for use as literals."""
    return [r["value"] for r in value_counts(df, col, n).collect()]


def supported_values(df: DataFrame, col: str, floor: int) -> DataFrame:
    """Values that occur more than ``floor`` times."""
    return frequencies(df, col).filter(F.col("n") > floor)


def keep_supported(df: DataFrame, col: str, floor: int) -> DataFrame:
    """Rows whose value occurs more than ``floor`` times; null never does."""
    supported = cut_lineage(supported_values(df, col, floor))
    return lookup(df, supported.withColumnRenamed("value", col), col, "n", "left_semi")


def supported_elements(df: DataFrame, col: str, at_least: int) -> DataFrame:
    """Array elements that occur at least ``at_least`` times over all rows."""
    return frequencies(df.select(F.explode(col).alias("e")), "e").filter(F.col("n") >= at_least)


def keep_supported_elements(df: DataFrame, row_id: str, col: str, at_least: int, out: str) -> DataFrame:
    """Add ``out``, the supported elements of ``col`` in order with repeats; drop rows left empty."""
    supported = cut_lineage(supported_elements(df, col, at_least))
    few = bounded_rows(supported)
    if few is not None:
        common = F.array(*[F.lit(r["value"]) for r in few]).cast("array<string>")
        kept = df.withColumn(out, F.filter(F.col(col), lambda x: F.array_contains(common, x)))
        return kept.filter(F.size(out) > 0)
    each = df.select(row_id, F.posexplode(col).alias("_p", "_e"))
    held = lookup(each, supported.withColumnRenamed("value", "_e"), "_e", "n", "left_semi")
    lists = held.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("_p", "_e"))).alias("_l"))
    return df.join(lists.select(row_id, F.col("_l._e").alias(out)), row_id)


def repeat_report(df: DataFrame, col: str, at_least: int) -> DataFrame:
    """Distinct values, values seen once, values seen ``at_least`` times, highest count."""
    return frequencies(df, col).agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count_if(F.col("n") == 1).alias("n_singletons"),
        F.count_if(F.col("n") >= at_least).alias("n_repeated"),
        F.max("n").alias("max_n"),
    )


def top_series(df: DataFrame, col: str, chart: str, n: int) -> DataFrame:
    """Bars of a top-``n`` chart as ``(chart, rank, x, y)``."""
    # The window sees no more than the n rows of the top list.
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "value"))
    top = value_counts(df, col, n)
    return top.select(F.lit(chart).alias("chart"), rank.alias("rank"), F.col("value").cast("string").alias("x"), F.col("n").alias("y"))


def key_series(df: DataFrame, col: str, chart: str) -> DataFrame:
    """Points of a line chart over all keys."""
    counts = cut_lineage(frequencies(df, col))
    few = bounded_rows(counts)
    if few is None:
        ranked = rank_all(counts, [F.col("value")], "rank", start=1)
    else:
        ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy("value")))
    return ranked.select(
        F.lit(chart).alias("chart"),
        F.col("rank").cast("int").alias("rank"),
        F.col("value").cast("string").alias("x"),
        F.col("n").alias("y"),
    )


def top_charts(df: DataFrame, charts: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """Bars of several top lists as ``(chart, rank, x, y)``, from one scan and one count.

    ``charts`` names each chart's value, null where a row has none, and the length of its list.
    Values are compared as strings. Each task passes on only the top of what it holds.
    """
    cells = [F.struct(F.lit(name).alias("chart"), value.cast("string").alias("x")) for name, (value, _) in charts.items()]
    counts = df.select(F.inline(F.array(*cells))).filter("x is not null").groupBy("chart", "x").agg(F.count(F.lit(1)).alias("y"))
    rank = F.row_number().over(Window.partitionBy("chart").orderBy(F.desc("y"), "x"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= max(n for _, n in charts.values()))
    length = F.lit(0)
    for name, (_, n) in charts.items():
        length = F.when(F.col("chart") == name, n).otherwise(length)
    return top.filter(F.col("rank") <= length).select("chart", "rank", "x", "y")


def chart_series(charts: Mapping[str, DataFrame]) -> DataFrame:
    """The series of several charts in one table."""
    out = None
    for df in charts.values():
        out = df if out is None else out.unionByName(df)
    return out
