"""Fit candidates, keep the best on validation, test it once, store the artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscat.operators import bayes, evaluate
from corpuscat.operators.tokens import load_vocabulary, save_vocabulary
from corpuscat.session import cut_lineage
from corpuscat.sources.stored import save_report, save_table


def train_bayes(
    rows: DataFrame,
    row_id: str,
    words: str,
    out_dir: str,
    index: DataFrame,
    alphas: Sequence[float] = (0.1, 1.0, 10.0),
    max_length: int = 512,
) -> DataFrame:
    """One report row for labelled, split ``rows`` (``label``, ``split``).

    Stores under ``out_dir``: model, label index, vocabulary, history and report. The
    report names ``max_length``, the length that texts are encoded to with the vocabulary.
    """
    part = F.col("split")
    model = bayes.fit_bayes(rows.filter(part == "train"), words, "label")
    scored = bayes.bayes_predict(rows.filter(part == "val"), row_id, words, "label", model, alphas)
    hist = save_table(evaluate.history(cut_lineage(scored)), f"{out_dir}/history")
    best = evaluate.select_best(hist).first()

    tested = bayes.bayes_predict(rows.filter(part == "test"), row_id, words, "label", model, [alphas[best["candidate"]]])
    scores = evaluate.history(cut_lineage(tested)).drop("candidate")
    model.save(f"{out_dir}/model")
    save_table(index, f"{out_dir}/labels")
    save_vocabulary(model.terms.select("token", "n"), f"{out_dir}/vocabulary")
    config = {
        "model_name": "naive_bayes",
        "alpha": float(alphas[best["candidate"]]),
        "max_length": max_length,
        "num_labels": index.count(),
        "best_val_f1": best["micro_f1"],
    }
    return save_report(scores, config, f"{out_dir}/report")


def read_run(spark: SparkSession, out_dir: str) -> DataFrame:
    """A stored run as one row: settings, sizes of the stored tables, test metrics.

    The model is loaded and the label and vocabulary tables are counted as stored.
    """
    report = spark.read.json(f"{out_dir}/report")
    classes = bayes.BayesModel.load(spark, f"{out_dir}/model").classes.count()
    stored = spark.read.parquet(f"{out_dir}/labels").count()
    words = load_vocabulary(spark, f"{out_dir}/vocabulary").count()
    if stored != report.first()["num_labels"] or classes > stored:
        raise ValueError("the stored labels are not those of the report")
    sizes = [F.lit(stored).cast("bigint").alias("num_labels"), F.lit(words).cast("bigint").alias("vocabulary_size")]
    return report.select("model_name", "alpha", F.col("max_length").cast("int"), *sizes, "best_val_f1", "test_metrics.*")
