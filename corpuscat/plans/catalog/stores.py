"""Round trips through stored forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscat.operators import bayes, evaluate, frequency
from corpuscat.plans.catalog import models
from corpuscat.plans.catalog.registry import query
from corpuscat.session import cut_lineage, scratch_path
from corpuscat.sources import delimited, stored
from corpuscat.sources.tables import table


@query("src_csv_roundtrip", "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents")
def src_csv_roundtrip(spark, folder):
    docs = table(spark, folder, "documents")
    path = scratch_path(spark, "csv")
    delimited.write_delimited(docs, path)
    return delimited.read_delimited(spark, path, docs.schema, row_id="doc_id")


@query(
    "src_csv_one_file",
    "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents",
)
def src_csv_one_file(spark, folder):
    """One file in the corpus' layout, its first column without a name, read in blocks and numbered in file order.

    Beyond ``delimited.FILE_BYTES`` of text it goes on in a next file, as one task writes a file.
    """
    docs = table(spark, folder, "documents")
    path = scratch_path(spark, "csv")
    delimited.write_in_order(docs, path, "doc_id", ["", *docs.columns[1:]])
    return delimited.read_delimited(spark, path, docs.schema, columns={"_c0": "doc_id"})


@query("src_materialise", "SELECT lang AS value, 2 * count(*) AS n FROM documents GROUP BY lang")
def src_materialise(spark, folder):
    """A result kept for its input: found again while the files are the same, built anew when some are added."""
    root, source = scratch_path(spark, "cache"), scratch_path(spark, "input")

    def counts(build=None):
        docs = spark.read.parquet(source)
        path = stored.stored_path(root, "languages", {"column": "lang"}, [docs])
        return stored.materialise(spark, path, build or (lambda: frequency.frequencies(docs, "lang")))

    langs = table(spark, folder, "documents").select("lang")
    langs.write.parquet(source)
    counts()
    counts(lambda: langs.limit(0))  # found, so not built
    langs.write.mode("append").parquet(source)
    return counts()


@query("model_save_load", models.NB_SQL)
def model_save_load(spark, folder):
    rows = models.documents_by(spark, folder, "lang")
    path = scratch_path(spark, "model")
    bayes.fit_bayes(rows.filter("split = 'train'"), "words", "label").save(path)
    model = bayes.BayesModel.load(spark, path)
    out = bayes.bayes_predict(rows.filter("split = 'test'"), "row_id", "words", "label", model)
    return out.select("row_id", "label", "prediction", F.round("score", 4).alias("score"))


@query(
    "run_report",
    f"{models._TEST} SELECT 'naive_bayes' AS model_name, (SELECT count(DISTINCT source) FROM documents) AS num_labels, {models.ROUNDED} FROM history",
)
def run_report(spark, folder):
    scores = evaluate.history(cut_lineage(models.predictions(spark, folder, "source", "test"))).drop("candidate")
    classes = table(spark, folder, "documents").select("source").distinct().count()
    config = {"model_name": "naive_bayes", "num_labels": classes}
    saved = stored.save_report(scores, config, scratch_path(spark, "report"))
    return models.rounded(saved.select("model_name", F.col("num_labels").cast("bigint"), "test_metrics.*"))
