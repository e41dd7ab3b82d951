"""Numeric profiles that are kept and merged: a load reads only the files that are new to it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscat.operators.enrich import stored_rows
from corpuscat.operators.profile import QUARTILES, numeric_columns, with_quartiles
from corpuscat.operators.scale import spread

SKETCH_K = 4096  # size of a sketch: its ranks are off by about 0.0013
MARGIN = 0.003  # share of the values kept to each side of a quartile

_FILE = ["path", "length", "modificationTime"]
_MOMENTS = "load string, column string, n bigint, mean double, m2 double, min double, max double, sketch binary"


def _listed(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(list(files)).select(*_FILE)


def _moments(df: DataFrame, columns: Sequence[str], load: str) -> DataFrame:
    """One row per column: its count, mean, squared deviations, extremes and a sketch, in one pass."""
    nums = spread(df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    one = [
        F.struct(
            F.lit(load).alias("load"),
            F.lit(name).alias("column"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            (F.var_pop(c) * F.count(c)).alias("m2"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
            F.kll_sketch_agg_double(c, SKETCH_K).alias("sketch"),
        )
        for c, name in zip(nums.columns, columns)
    ]
    return nums.agg(F.array(*one).alias("rows")).select(F.inline("rows"))


def _merged(kept: DataFrame) -> DataFrame:
    """One row per column over all loads; deviations are taken from the common mean."""
    each = Window.partitionBy("column")  # one row per load
    total = F.sum("n").over(each)
    mean = F.sum(F.col("n") * F.col("mean")).over(each) / total
    around = [min(max(p + d, 0.0), 1.0) for p in QUARTILES for d in (-MARGIN, MARGIN)]
    spread_out: Column = F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2.0))
    rows = kept.filter("n > 0").withColumn("_mean", mean)
    whole = rows.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.first("_mean").alias("mean"),
        F.sum(spread_out).alias("m2"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )
    bounds = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(q)) for q in around])
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return whole.select("column", "n", "mean", std.alias("std"), "min", "max", bounds.alias("bounds"))


def update_profile(
    spark: SparkSession, files: Sequence[str], read: Callable[[Sequence[str]], DataFrame], store: str, columns: Sequence[str] | None = None
) -> tuple[DataFrame, int]:
    """Bring the profile at ``store`` up to ``files``; returns one row per column, and how many files were read.

    A load is a set of files that came together: its row per column is kept as long as each of
    its files is there with its length and time. Files of no such load, new, changed or left
    over from a load that lost one, are read in one pass and stored as the next load. Rows are
    written before the files they stand for, so a load that broke off counts as not made.
    The columns are those of the first load; of no files there is no row.
    """
    moments, members = f"{store}/moments", f"{store}/files"
    seen = stored_rows(spark, members) if files else None
    valid: list[str] = []
    fresh = list(files)
    if seen is not None:
        now = _listed(spark, files).withColumn("_here", F.lit(True))
        found = seen.join(now, _FILE, "left")
        whole = found.groupBy("load").agg(F.bool_and(F.coalesce("_here", F.lit(False))).alias("whole"))
        valid = [r["load"] for r in whole.filter("whole").collect()]  # one short string a load
        known = seen.filter(F.col("load").isin(valid)) if valid else seen.limit(0)
        fresh = [r["path"] for r in now.join(known, _FILE, "left_anti").select("path").collect()]
    if fresh:
        part = read(fresh)
        load = uuid.uuid4().hex
        wanted = list(columns or numeric_columns(part))
        _moments(part, wanted, load).write.mode("append").parquet(moments)
        _listed(spark, fresh).select(F.lit(load).alias("load"), *_FILE).write.mode("append").parquet(members)
        valid = [*valid, load]
    if not valid:
        return spark.createDataFrame([], "column string, n bigint, mean double, std double, min double, max double, bounds array<double>"), 0
    kept = spark.read.schema(_MOMENTS).parquet(moments).filter(F.col("load").isin(valid))
    return _merged(kept), len(fresh)


def stored_numeric_summary(
    spark: SparkSession, files: Sequence[str], read: Callable[[Sequence[str]], DataFrame], store: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """``profile.numeric_summary`` of ``files`` with the moments and bounds of the profile at ``store``.

    Only new files are read for those; the exact quartiles then take one pass over all files
    that counts what is below the bounds and sorts the few values between them.
    """
    merged, _ = update_profile(spark, files, read, store, columns)
    rows = {r["column"]: r for r in merged.collect()}
    whole = read(files)
    names = list(columns or numeric_columns(whole))
    nums = spread(whole.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)]))
    empty = {"n": 0, "mean": None, "std": None, "min": None, "max": None, "bounds": None}
    taken = {f"c{i}": rows[c].asDict() if c in rows else {"column": c, **empty} for i, c in enumerate(names)}
    return with_quartiles(nums, taken)
