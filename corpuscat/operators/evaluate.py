"""Metrics of single-label predictions, all from one table of (label, prediction) counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscat.session import cut_lineage


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(df: DataFrame, classes: Sequence[int], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One column per predicted class, for display."""
    return df.groupBy(label).pivot(prediction, list(classes)).count().fillna(0)


def _ratio(num: Column, den: Column) -> Column:
    """Zero where undefined."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.when(den != 0, den))


def per_class(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """True positives, false positives, false negatives and scores of each class.

    ``counts`` comes from ``confusion``; classes are all that occur as label or prediction.
    """
    y, p, n, zero = F.col("label"), F.col("prediction"), F.col("n"), F.lit(0).cast("bigint")

    def cell(c: Column, tp: Column, fp: Column, fn: Column) -> Column:
        return F.struct(c.cast("bigint").alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    cells = F.when(y == p, F.array(cell(y, n, zero, zero))).otherwise(
        F.array(cell(y, zero, zero, n), cell(p, zero, n, zero))
    )
    sums = counts.select(*by, F.inline(cells)).groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return sums.select(
        *by,
        F.col("class").alias("label"),
        "tp",
        "fp",
        "fn",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, micro and macro precision, recall and F1; one row per ``by``."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    scored = per_class(counts, by)
    return scored.groupBy(*by).agg(
        _ratio(tp, tp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("micro_precision"),
        _ratio(tp, tp + fn).alias("micro_recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )


def log_loss(df: DataFrame, loss: str = "loss", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"))


def history(predictions: DataFrame, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """One row of metrics per candidate, from one pass over the predictions."""
    counts = predictions.groupBy(*by, "label", "prediction").agg(
        F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss"), F.count("loss").alias("n_loss")
    )
    counts = cut_lineage(counts)
    loss = counts.groupBy(*by).agg((F.sum("loss") / F.sum("n_loss")).alias("log_loss"))
    return metrics(counts, by).join(loss, list(by))


def select_best(hist: DataFrame, metric: str = "micro_f1") -> DataFrame:
    """The candidate with the highest metric; the first one on a tie."""
    return hist.orderBy(F.desc(metric), "candidate").limit(1)


def long_series(hist: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Metric columns as rows ``(*ids, metric, value)``."""
    values = [c for c in hist.columns if c not in ids]
    return hist.unpivot(list(ids), values, "metric", "value")
