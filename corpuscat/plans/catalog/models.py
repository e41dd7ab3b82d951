"""Classifiers, candidate histories, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscat.functions.text import words as split_words
from corpuscat.operators import bayes, evaluate, labels, linear, split
from corpuscat.operators.scale import spread
from corpuscat.plans.catalog import registry
from corpuscat.plans.catalog.registry import query, words
from corpuscat.plans.training import read_run, train_bayes
from corpuscat.session import cut_lineage, scratch_path
from corpuscat.sources.stored import save_table
from corpuscat.sources.tables import table

ALPHAS = (0.1, 1.0, 10.0)


def documents_by(spark, folder, category: str):
    """``(row_id, words, category, label, split)``: documents with an indexed label and 64/16/20 parts.

    Words are stored once; labels and parts are joined on as the table is read.
    """
    docs = spread(table(spark, folder, "documents")).select(
        F.col("doc_id").alias("row_id"), split_words(F.col("text")).alias("words"), F.col(category).alias("category")
    )
    docs = cut_lineage(docs)
    labelled = labels.attach_label(docs, "category", labels.label_index(docs, "category"))
    return split.split_64_16_20(labelled, "label", "row_id")


def _bayes(category: str, part: str, alphas: tuple[float, ...], source: str = "documents") -> str:
    """CTEs over ``source`` (doc_id, text and the category), up to ``predicted(row_id, candidate, alpha, label, prediction, score, loss)``."""
    values = ", ".join(f"({i}, {a}::DOUBLE)" for i, a in enumerate(alphas))
    return f"""WITH classes AS (SELECT {category} AS c, (row_number() OVER (ORDER BY {category}) - 1)::BIGINT AS label FROM documents GROUP BY {category}),
base AS (SELECT doc_id AS row_id, text, label FROM {source} JOIN classes ON c = {category}),
{registry.split('base', split.SPLIT_64_16_20)},
each AS (SELECT b.row_id, b.label, p.split, unnest({words('b.text')}) AS token FROM base b JOIN parts p ON b.row_id = p.row_id),
term AS (SELECT token, label, count(*) AS n FROM each WHERE split = 'train' GROUP BY token, label),
vocab AS (SELECT DISTINCT token FROM term),
smooth(candidate, alpha) AS (VALUES {values}),
stats AS (SELECT d.label, d.docs, sum(d.docs) OVER () AS total, coalesce(t.tokens, 0) AS tokens, (SELECT count(*) FROM vocab) AS v
  FROM (SELECT label, count(*) AS docs FROM parts WHERE split = 'train' GROUP BY label) d
  LEFT JOIN (SELECT label, sum(n) AS tokens FROM term GROUP BY label) t ON d.label = t.label),
seen AS (SELECT row_id, count(*) AS l FROM each JOIN vocab USING (token) WHERE split = '{part}' GROUP BY row_id),
hit AS (SELECT e.row_id, t.label AS c, candidate, sum(round(ln((n + alpha) / alpha) * 1e11)::BIGINT) AS s FROM each e JOIN term t ON e.token = t.token, smooth
  WHERE e.split = '{part}' GROUP BY ALL),
scored AS (SELECT p.row_id, p.label, a.candidate, a.alpha, k.label AS c,
    (ln(k.docs::DOUBLE / k.total) + coalesce(l, 0) * ln(a.alpha / (k.tokens + a.alpha * k.v))) + coalesce(h.s, 0)::BIGINT::DOUBLE / 1e11::DOUBLE AS score
  FROM (SELECT * FROM parts WHERE split = '{part}') p CROSS JOIN stats k CROSS JOIN smooth a
  LEFT JOIN seen ON seen.row_id = p.row_id
  LEFT JOIN hit h ON h.row_id = p.row_id AND h.c = k.label AND h.candidate = a.candidate),
peaks AS (SELECT row_id, candidate, max(score) AS peak FROM scored GROUP BY ALL),
losses AS (SELECT s.row_id, s.candidate, any_value(peak) + ln(sum(exp(score - peak))) - max(CASE WHEN c = label THEN score END) AS loss
  FROM scored s JOIN peaks p ON s.row_id = p.row_id AND s.candidate = p.candidate GROUP BY ALL),
winners AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, candidate ORDER BY score DESC, c) AS rn FROM scored) WHERE rn = 1),
predicted AS (SELECT w.row_id, w.candidate::INTEGER AS candidate, w.alpha, w.label, w.c AS prediction, w.score, l.loss
  FROM winners w JOIN losses l ON w.row_id = l.row_id AND w.candidate = l.candidate)"""


_SCORES = """counts AS (SELECT candidate, label, prediction, count(*) AS n FROM predicted GROUP BY ALL),
class_sums AS (SELECT candidate, label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (
  SELECT candidate, label, CASE WHEN label = prediction THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN label <> prediction THEN n ELSE 0 END AS fn FROM counts
  UNION ALL SELECT candidate, prediction, 0, n, 0 FROM counts WHERE label <> prediction) GROUP BY ALL),
class_scores AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM class_sums),
metrics AS (SELECT candidate, sum(tp)::DOUBLE / sum(tp + fn) AS accuracy, sum(tp)::DOUBLE / sum(tp + fp) AS micro_precision,
  sum(tp)::DOUBLE / sum(tp + fn) AS micro_recall, 2.0::DOUBLE * sum(tp) / sum(2 * tp + fp + fn) AS micro_f1,
  avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM class_scores GROUP BY candidate),
history AS (SELECT m.*, l.log_loss FROM metrics m JOIN (SELECT candidate, avg(loss) AS log_loss FROM predicted GROUP BY candidate) l
  ON m.candidate = l.candidate)"""

METRICS = ("accuracy", "micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1", "log_loss")
ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)


def rounded(df):
    return df.withColumns({m: F.round(m, 6) for m in METRICS if m in df.columns})


def predictions(spark, folder, category: str, part: str, alphas: tuple[float, ...] = (1.0,)):
    rows = documents_by(spark, folder, category)
    model = bayes.fit_bayes(rows.filter("split = 'train'"), "words", "label")
    return bayes.bayes_predict(rows.filter(F.col("split") == part), "row_id", "words", "label", model, alphas)


NB_SQL = f"{_bayes('lang', 'test', (1.0,))} SELECT row_id, label, prediction, round(score, 4) AS score FROM predicted"


@query("nb_classify", NB_SQL)
def nb_classify(spark, folder):
    return predictions(spark, folder, "lang", "test").select("row_id", "label", "prediction", F.round("score", 4).alias("score"))


_TEST = f"{_bayes('source', 'test', (1.0,))}, {_SCORES}"
_VAL = f"{_bayes('source', 'val', ALPHAS)}, {_SCORES}"


@query("eval_log_loss", f"{_TEST} SELECT round(log_loss, 6) AS log_loss FROM history")
def eval_log_loss(spark, folder):
    return rounded(evaluate.log_loss(predictions(spark, folder, "source", "test")))


@query("eval_metrics", f"{_TEST} SELECT {ROUNDED} FROM history")
def eval_metrics(spark, folder):
    return rounded(evaluate.history(cut_lineage(predictions(spark, folder, "source", "test")))).drop("candidate")


@query("confusion_matrix", f"{_TEST} SELECT label, prediction, n FROM counts")
def confusion_matrix(spark, folder):
    return evaluate.confusion(predictions(spark, folder, "source", "test"))


@query(
    "eval_per_class",
    f"{_TEST} SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM class_scores",
)
def eval_per_class(spark, folder):
    scored = evaluate.per_class(evaluate.confusion(predictions(spark, folder, "source", "test")))
    return scored.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def validation_history(spark, folder):
    """Metrics on ``val`` of each smoothing candidate fitted on ``train``."""
    return evaluate.history(cut_lineage(predictions(spark, folder, "source", "val", ALPHAS)))


@query("fit_history", f"{_VAL} SELECT candidate, {ROUNDED} FROM history")
def fit_history(spark, folder):
    return rounded(validation_history(spark, folder))


@query("select_best", f"{_VAL} SELECT candidate, round(micro_f1, 6) AS micro_f1 FROM history ORDER BY history.micro_f1 DESC, candidate LIMIT 1")
def select_best(spark, folder):
    return rounded(evaluate.select_best(validation_history(spark, folder))).select("candidate", "micro_f1")


@query(
    "report_series",
    f"{_VAL} SELECT candidate, metric, round(value, 6) AS value FROM (UNPIVOT history ON {', '.join(METRICS)} INTO NAME metric VALUE value)",
)
def report_series(spark, folder):
    return evaluate.long_series(validation_history(spark, folder), ["candidate"]).withColumn("value", F.round("value", 6))


HEAD_CHECKS = ("n_test", "n_labels", "accuracy_is_micro_f1", "beats_prior", "sums_to_one", "reload_agrees")


def _head_sql(base: str, plan: tuple, name: str) -> str:
    """What SQL can say of a fitted head: the size of its test part, and that each check holds."""
    return f"""WITH {base}, {registry.split('base', plan)}
SELECT count(*) AS n_test, count(DISTINCT label) AS n_labels, true AS accuracy_is_micro_f1, true AS beats_prior, true AS sums_to_one, true AS reload_agrees
FROM parts WHERE split = 'test'"""


def _head(spark, model, rows, name: str):
    report = linear.head_report(model, rows.filter("split = 'train'"), rows.filter("split = 'test'"), "row_id", scratch_path(spark, name))
    return report.select(*HEAD_CHECKS)


_LANG_BASE = """classes AS (SELECT lang AS c, (row_number() OVER (ORDER BY lang) - 1)::BIGINT AS label FROM documents GROUP BY lang),
base AS (SELECT doc_id AS row_id, label FROM documents JOIN classes ON c = lang)"""
_VECTOR_BASE = "base AS (SELECT vec_id AS row_id, label::BIGINT AS label FROM embeddings)"


@query("lr_text", _head_sql(_LANG_BASE, split.SPLIT_64_16_20, "lr_text"))
def lr_text(spark, folder):
    rows = documents_by(spark, folder, "lang")
    return _head(spark, linear.word_regression().fit(rows.filter("split = 'train'")), rows, "lr-text")


def vectors(spark, folder):
    emb = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", F.col("label").cast("bigint").alias("label"))
    return linear.with_vector(cut_lineage(split.split_80_10_10(emb, "label", "row_id")), "embedding")


@query("lr_vectors", _head_sql(_VECTOR_BASE, split.SPLIT_80_10_10, "lr_vectors"))
def lr_vectors(spark, folder):
    rows = vectors(spark, folder)
    grid = [linear.vector_regression(reg) for reg in (0.0, 0.1)]
    model, _ = linear.fit_candidates(rows.filter("split = 'train'"), rows.filter("split = 'val'"), grid, "row_id")
    return _head(spark, model, rows, "lr-vectors")


@query("mlp_vectors", _head_sql(_VECTOR_BASE, split.SPLIT_80_10_10, "mlp_vectors"))
def mlp_vectors(spark, folder):
    rows = vectors(spark, folder)
    shape = rows.agg(F.max(F.size("embedding")), F.max("label")).first()
    model = linear.vector_perceptron(shape[0], shape[1] + 1).fit(rows.filter("split = 'train'"))
    return _head(spark, model, rows, "mlp-vectors")


MAX_LENGTH = 512
_LANG_VAL = f"{_bayes('lang', 'val', ALPHAS)}, {_SCORES}"
_LANG_TEST = f"{_bayes('lang', 'test', ALPHAS)}, {_SCORES}"


@query(
    "train_run",
    f"""SELECT 'naive_bayes' AS model_name, alpha, {MAX_LENGTH} AS max_length, (SELECT count(DISTINCT lang) FROM documents) AS num_labels,
  (SELECT count(*) FROM ({_LANG_TEST} SELECT token FROM vocab)) AS vocabulary_size, round(best_val_f1, 6) AS best_val_f1, {ROUNDED}
FROM ({_LANG_VAL} SELECT h.candidate, a.alpha, h.micro_f1 AS best_val_f1 FROM history h JOIN smooth a ON h.candidate = a.candidate
    ORDER BY h.micro_f1 DESC, h.candidate LIMIT 1) b
JOIN ({_LANG_TEST} SELECT * FROM history) t ON t.candidate = b.candidate""",
)
def train_run(spark, folder):
    """The whole run: choose on validation, test the choice once, store all, read all back."""
    rows = documents_by(spark, folder, "lang")
    index = labels.label_index(table(spark, folder, "documents"), "lang")
    path = scratch_path(spark, "run")
    train_bayes(rows, "row_id", "words", path, index, ALPHAS, MAX_LENGTH)
    report = read_run(spark, path)
    return rounded(report.withColumn("best_val_f1", F.round("best_val_f1", 6)))


@query("label_store", "SELECT (row_number() OVER (ORDER BY source) - 1)::BIGINT AS label, source AS category, count(*) AS n FROM documents GROUP BY source")
def label_store(spark, folder):
    """The label mapping, stored and read back."""
    return save_table(labels.label_index(table(spark, folder, "documents"), "source"), scratch_path(spark, "labels")).select("label", "category", "n")
