"""Linear and two-layer classifiers over word features or given vectors (Spark ML)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscat.functions.text import word_array
from corpuscat.operators.evaluate import history, select_best
from corpuscat.session import cut_lineage


def with_words(df: DataFrame, text: str, out: str = "words") -> DataFrame:
    return df.withColumn(out, word_array(df, text))


def with_vector(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))


def word_regression(num_features: int = 1 << 18, reg: float = 0.0, max_iter: int = 10) -> Pipeline:
    """Hashed word counts with inverse document frequency, then a softmax regression."""
    return Pipeline(
        stages=[
            HashingTF(inputCol="words", outputCol="tf", numFeatures=num_features),
            IDF(inputCol="tf", outputCol="features"),
            LogisticRegression(family="multinomial", regParam=reg, maxIter=max_iter),
        ]
    )


def vector_regression(reg: float = 0.0, max_iter: int = 20) -> Pipeline:
    """Softmax regression over a vector column: a linear head."""
    return Pipeline(stages=[LogisticRegression(family="multinomial", regParam=reg, maxIter=max_iter)])


def vector_perceptron(width: int, classes: int, max_iter: int = 30, seed: int = 42) -> Pipeline:
    """A head with one hidden layer of half the input width."""
    layers = [width, width // 2, classes]
    return Pipeline(stages=[MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=seed)])


def predict(model: PipelineModel, df: DataFrame, row_id: str, label: str = "label") -> DataFrame:
    """``(row_id, label, prediction, loss)``; on equal probability the lowest label wins."""
    scored = model.transform(df).withColumn("p", vector_to_array("probability"))
    own = F.get("p", F.col(label).cast("int"))
    return scored.select(
        row_id,
        F.col(label).cast("bigint").alias("label"),
        (F.array_position("p", F.array_max("p")) - 1).cast("bigint").alias("prediction"),
        # a class the model never saw has no probability; the floor keeps the loss finite
        (-F.log(F.greatest(F.coalesce(own, F.lit(0.0)), F.lit(1e-15)))).alias("loss"),
    )


def head_report(model: PipelineModel, train: DataFrame, test: DataFrame, row_id: str, path: str) -> DataFrame:
    """One row on a fitted head: its test rows and metrics, and whether it holds what any head must.

    ``beats_prior``: the loss on ``train`` is below that of the class shares. ``sums_to_one``:
    so do all probabilities. ``reload_agrees``: stored at ``path`` and loaded again, the
    model predicts the same for all of ``test``.
    """
    model.write().overwrite().save(path)
    again = predict(PipelineModel.load(path), test, row_id).select(row_id, F.col("prediction").alias("again"))
    tested = cut_lineage(predict(model, test, row_id).withColumn("candidate", F.lit(0)))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # one row per class
    prior = train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select((-share * F.log(share)).alias("part")).agg(F.sum("part").alias("prior"))
    own = predict(model, train, row_id).agg(F.avg("loss").alias("train_loss"))
    off = F.abs(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, p: a + p) - 1)
    sums = model.transform(test).agg((F.max(off) < 1e-6).alias("sums_to_one"))
    agree = tested.join(again, row_id).agg(F.count(F.lit(1)).alias("n_test"), F.count_distinct("label").alias("n_labels"), (F.count_if(F.col("prediction") != F.col("again")) == 0).alias("reload_agrees"))
    scores = history(tested).withColumn("accuracy_is_micro_f1", F.abs(F.col("accuracy") - F.col("micro_f1")) < 1e-12)
    # Each side is one row.
    for one in (prior, own, sums, agree):
        scores = scores.withColumn("_k", F.lit(1)).join(one.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return scores.withColumn("beats_prior", F.col("train_loss") < F.col("prior")).drop("candidate")


def fit_candidates(
    train: DataFrame, val: DataFrame, candidates: Sequence[Estimator], row_id: str, metric: str = "micro_f1"
) -> tuple[PipelineModel, DataFrame]:
    """Fit each candidate on ``train``, score it on ``val``, keep the best.

    Returns the model and the history, one row of metrics per candidate; the first
    candidate wins a tie.
    """
    models = [c.fit(train) for c in candidates]
    scored = None
    for i, m in enumerate(models):
        one = predict(m, val, row_id).withColumn("candidate", F.lit(i))
        scored = one if scored is None else scored.unionByName(one)
    rows = history(scored).collect()  # one row per candidate; scored once
    hist = train.sparkSession.createDataFrame(rows)
    return models[select_best(hist, metric).first()["candidate"]], hist
