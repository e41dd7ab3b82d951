"""Profiles of a table: shape, head, types, missing values, numeric summary, stage counts."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscat.operators.scale import range_placed, spread
from corpuscat.session import cut_lineage

QUARTILES = (0.25, 0.5, 0.75)
MARGIN = 0.001  # share of the values kept to each side of a quartile


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def head(df: DataFrame, row_id: str, n: int = 5) -> DataFrame:
    """First ``n`` rows in file order."""
    return df.orderBy(row_id).limit(n)


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")


def missing_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, in one pass."""
    sums = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(df.columns)]
    return sums.select(F.inline(F.array(*pairs)))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, margin: float = MARGIN) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per numeric column.

    One pass takes the moments and, from a sketch, bounds a little to both sides of each
    quartile. A second pass counts the values below those bounds and keeps the few between
    them, by value; only these are sorted, and the wanted ranks are read off. Where a rank
    lies outside its bounds after all, that column is done again with all its values.
    """
    columns = list(columns or numeric_columns(df))
    nums = spread(df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    around = [min(max(p + d, 0.0), 1.0) for p in QUARTILES for d in (-margin, margin)]
    moments = nums.agg(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
                F.percentile_approx(c, around, int(4 / margin)).alias("bounds"),
            ).alias(c)
            for c, name in zip(nums.columns, columns)
        ]
    )
    return with_quartiles(nums, moments.first().asDict())  # one row for each column


def with_quartiles(nums: DataFrame, taken: Mapping[str, Row]) -> DataFrame:
    """The summary of each column of ``nums``, from its moments and the bounds of its quartiles."""
    rows = {c: r for c, r in taken.items() if r["n"]}
    spans = {(c, i): (rows[c]["bounds"][2 * i], rows[c]["bounds"][2 * i + 1]) for c in rows for i in range(len(QUARTILES))}
    value, lost = _ranks_between(nums, spans, {c: r["n"] for c, r in rows.items()}) if spans else ({}, [])
    if lost:
        wide = {(c, i): (rows[c]["min"], rows[c]["max"]) for c, i in lost}
        value |= _ranks_between(nums, wide, {c: r["n"] for c, r in rows.items()})[0]
    places = [f"p{int(p * 100)}" for p in QUARTILES]
    found = [
        (r["column"], r["n"], r["mean"], r["std"], r["min"], *[value.get((c, i)) for i in range(len(QUARTILES))], r["max"])
        for c, r in taken.items()
    ]
    schema = f"column string, n bigint, mean double, std double, min double, {', '.join(f'{p} double' for p in places)}, max double"
    return nums.sparkSession.createDataFrame(found, schema)


def _ranks_between(nums: DataFrame, spans: dict, totals: dict) -> tuple[dict, list]:
    """Quartiles of each ``(column, quartile)`` in ``spans``, and those whose rank is outside its bounds."""
    keys = list(spans)
    below = nums.agg(*[F.count_if(F.col(c) < spans[c, i][0]).alias(f"b{k}") for k, (c, i) in enumerate(keys)]).first()
    entries = [F.when(F.col(c).between(*spans[c, i]), F.struct(F.lit(str(k)).alias("column"), F.col(c).alias("v"))) for k, (c, i) in enumerate(keys)]
    between = nums.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    between = cut_lineage(between.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")))
    held = {r["column"]: r["n"] for r in between.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    places, lost = {}, []
    for k, (c, i) in enumerate(keys):
        place = (totals[c] - 1) * QUARTILES[i] - below[f"b{k}"]
        if place < 0 or math.ceil(place) >= held.get(str(k), 0):
            lost.append((c, i))
        else:
            places[str(k)] = [place]
    if not places:
        return {}, lost
    found = sorted_quantiles(between.filter(F.col("column").isin(list(places))), places)
    return {keys[int(k)]: v[0] for k, v in found.items()}, lost


def sorted_quantiles(counted: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[float]]:
    """Values at the ``wanted`` ranks of each column, from ``(column, v, n)``; between ranks by line.

    The values are range-sorted and stored; each wanted rank then lies in one known block,
    and only these blocks are scanned. The driver sees one count per block and two values
    per quantile.
    """
    placed = range_placed(counted, [F.col("column"), F.col("v")])
    blocks = placed.groupBy("column", "_block").agg(F.sum("n").alias("n")).orderBy("column", "_block").collect()

    totals: dict[str, int] = {}
    spans = []
    for r in blocks:
        before = totals.get(r["column"], 0)
        totals[r["column"]] = before + r["n"]
        spans.append((r["column"], r["_block"], before, before + r["n"]))
    ranks = {c: sorted({int(x) for x in xs} | {min(int(x) + 1, totals[c] - 1) for x in xs}) for c, xs in wanted.items()}
    hits = [(c, b, lo, k) for c, b, lo, hi in spans for k in ranks[c] if lo <= k < hi]

    target = counted.sparkSession.createDataFrame(hits, "column string, _block int, before bigint, k bigint")
    running = F.sum("n").over(Window.partitionBy("column", "_block").orderBy("v"))
    found = (
        placed.join(F.broadcast(target.select("column", "_block").distinct()), ["column", "_block"], "left_semi")
        .withColumn("upto", running)
        .join(F.broadcast(target), ["column", "_block"])
        .filter("k >= before + upto - n and k < before + upto")
        .select("column", "k", "v")
        .collect()
    )
    value = {(r["column"], r["k"]): r["v"] for r in found}

    def at(c: str, x: float) -> float:
        low, high = value[c, int(x)], value[c, min(int(x) + 1, totals[c] - 1)]
        return low + (high - low) * (x - int(x))

    return {c: [at(c, x) for x in xs] for c, xs in wanted.items()}


def stage_counts(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each named stage; each count reads only the columns its stage filters on."""
    out = None
    for name, df in stages.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out
