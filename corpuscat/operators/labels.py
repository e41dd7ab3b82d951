"""Label tables and label columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscat.operators.frequency import frequencies
from corpuscat.operators.scale import bounded_rows, lookup, rank_all
from corpuscat.session import cut_lineage


def label_index(df: DataFrame, col: str) -> DataFrame:
    """``(label, category, n)``: dense labels over the sorted distinct categories."""
    counts = frequencies(df, col)
    few = bounded_rows(counts)
    if few is None:
        return rank_all(counts, [F.col("value")], "label").select("label", F.col("value").alias("category"), "n")
    kind = counts.schema["value"].dataType.simpleString()
    rows = [(i, r["value"], r["n"]) for i, r in enumerate(sorted(few, key=lambda r: r["value"]))]
    return df.sparkSession.createDataFrame(rows, f"label bigint, category {kind}, n bigint")


def element_index(df: DataFrame, col: str) -> DataFrame:
    """``label_index`` over all elements of an array column."""
    return label_index(df.select(F.explode(col).alias("e")), "e")


def attach_label(df: DataFrame, col: str, index: DataFrame, how: str = "inner") -> DataFrame:
    """Add the label of each row's category.

    With ``how="inner"`` rows whose category is not in the index, null included, are left
    out; with ``"left"`` they stay with a null label.
    """
    return lookup(df, index.select(F.col("category").alias(col), "label", "n"), col, "n", how)


def label_positions(df: DataFrame, row_id: str, col: str, index: DataFrame) -> DataFrame:
    """``(row_id, positions)``: the sorted distinct labels of each row's list, the sparse multi-hot form.

    ``index`` is the stored ``element_index`` of the column. Any number of classes will do.
    """
    each = df.select(row_id, F.explode_outer(F.array_distinct(F.col(col))).alias("category"))
    found = lookup(each, index.select("category", "label", "n"), "category", "n", "left")
    return found.groupBy(row_id).agg(F.sort_array(F.collect_list("label")).alias("positions"))


def dense_row(positions: Column, n_classes: Column) -> Column:
    """0/1 per class, from the sparse form."""
    zeros = F.transform(F.sequence(F.lit(0).cast("bigint"), n_classes - 1), lambda i: F.array_contains(positions, i).cast("int"))
    return F.when(n_classes > 0, zeros).otherwise(F.array().cast("array<int>"))


def label_from_list(df: DataFrame, col: str, index: DataFrame) -> DataFrame:
    """Label of the first class, in sorted order, that a row's list holds."""
    chosen = df.withColumn("category", F.array_min(col))
    n = frequencies(chosen, "category").withColumnRenamed("value", "category")
    weighed = cut_lineage(index.drop("n").join(n, "category"))
    return attach_label(chosen, "category", weighed)
