"""Heads trained step by step, their history and the best step's predictions, against the same steps in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscat.operators import split, steps
from corpuscat.plans.catalog import models, registry
from corpuscat.plans.catalog.registry import query
from corpuscat.session import cut_lineage, scratch_path
from corpuscat.sources.tables import table

LINEAR = {"hidden": 0, "steps": 8, "rate": 2.0, "patience": 4}
LAYERED = {"hidden": 16, "steps": 6, "rate": 0.5, "patience": 3}


def _start(name: str, units: str, inputs: str, zero: bool) -> str:
    rule = "0.0::DOUBLE" if zero else "CASE WHEN pos = 0 THEN 0.0::DOUBLE ELSE ((37 * u + 17 * pos + u * pos) % 101 - 50) / 250.0::DOUBLE END"
    return f"{name} AS MATERIALIZED (SELECT u, pos, {rule} AS w FROM (SELECT unnest(range({units})) AS u), (SELECT unnest(range({inputs} + 1)) AS pos))"


def _moved(new: str, old: str, errors: str, given: str, rate: float) -> str:
    """Weights after a step: ``errors(row_id, u, e)`` times what the layer was given, over the training rows."""
    return f"""{new} AS MATERIALIZED (SELECT o.u, o.pos, o.w - {rate}::DOUBLE * g.g / (SELECT count(*) FROM parts WHERE split = 'train') AS w
  FROM {old} o JOIN (SELECT e.u, x.pos, sum(e.e * x.v) AS g FROM {errors} e JOIN {given} x ON x.row_id = e.row_id GROUP BY e.u, x.pos) g ON g.u = o.u AND g.pos = o.pos)"""


def _steps_sql(hidden: int, steps: int, rate: float, patience: int) -> str:
    """CTEs of every step, up to ``best_step(step)``, ``last_step(step)`` and ``history`` by candidate."""
    width, classes = "(SELECT max(len(embedding)) FROM embeddings)", "(SELECT max(label) + 1 FROM embeddings)"
    out = [models._VECTOR_BASE, registry.split("base", split.SPLIT_80_10_10)]
    out.append("""x AS MATERIALIZED (SELECT p.row_id, unnest(range(len(embedding) + 1)) AS pos, unnest(list_prepend(1.0::DOUBLE, embedding::DOUBLE[])) AS v
  FROM parts p JOIN embeddings ON vec_id = row_id)""")
    out.append(_start("w0", classes, str(hidden) if hidden else width, not hidden))
    if hidden:
        out.append(_start("h0", str(hidden), width, False))
    for t in range(steps + 1):
        given = "x"
        if hidden:
            given = f"x{t}"
            out.append(f"""x{t} AS MATERIALIZED (SELECT row_id, u + 1 AS pos, greatest(sum(v * w), 0.0::DOUBLE) AS v FROM x JOIN h{t} h ON h.pos = x.pos GROUP BY row_id, u
  UNION ALL SELECT row_id, 0, 1.0::DOUBLE FROM parts)""")
        out.append(f"""z{t} AS MATERIALIZED (SELECT row_id, u, sum(v * w) AS z FROM {given} x JOIN w{t} w ON w.pos = x.pos GROUP BY row_id, u),
p{t} AS MATERIALIZED (SELECT row_id, u, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY row_id) AS p FROM (SELECT *, max(z) OVER (PARTITION BY row_id) AS m FROM z{t})),
e{t} AS MATERIALIZED (SELECT p.row_id, u, p - (u = label)::INTEGER AS e FROM p{t} p JOIN parts q ON q.row_id = p.row_id WHERE split = 'train')""")
        if t < steps:
            out.append(_moved(f"w{t + 1}", f"w{t}", f"e{t}", given, rate))
        if t < steps and hidden:
            out.append(f"""b{t} AS MATERIALIZED (SELECT e.row_id, w.pos - 1 AS u, sum(e.e * w.w) * (any_value(x.v) > 0)::INTEGER AS e
  FROM e{t} e JOIN w{t} w ON w.u = e.u AND w.pos > 0 JOIN x{t} x ON x.row_id = e.row_id AND x.pos = w.pos GROUP BY e.row_id, w.pos)""")
            out.append(_moved(f"h{t + 1}", f"h{t}", f"b{t}", "x", rate))
    every = " UNION ALL ".join(f"SELECT {t} AS step, * FROM p{t}" for t in range(steps + 1))
    out.append(f"""steps AS MATERIALIZED (SELECT s.step, s.row_id, q.label, q.split, max(CASE WHEN u = q.label THEN -ln(greatest(p, 1e-15::DOUBLE)) END) AS loss,
    max(p) AS probability, min(CASE WHEN p = top THEN u END) AS prediction
  FROM (SELECT *, max(p) OVER (PARTITION BY step, row_id) AS top FROM ({every})) s JOIN parts q ON q.row_id = s.row_id GROUP BY s.step, s.row_id, q.label, q.split),
predicted AS (SELECT step AS candidate, row_id, label, prediction, loss FROM steps WHERE split = 'val')""")
    out.append(models._SCORES)
    out.append(f"""so_far AS (SELECT candidate AS step, accuracy, max(accuracy) OVER (ORDER BY candidate) AS upto FROM history),
since AS (SELECT step, step - (SELECT min(b.step) FROM so_far b WHERE b.accuracy = a.upto) AS waited FROM so_far a),
last_step AS (SELECT coalesce((SELECT min(step) FROM since WHERE waited >= {patience}), {steps}) AS step),
best_step AS (SELECT step FROM so_far WHERE step <= (SELECT step FROM last_step) ORDER BY accuracy DESC, step LIMIT 1)""")
    return "WITH " + ",\n".join(out)


def _history_sql(setup: dict) -> str:
    return f"""{_steps_sql(**setup)}
SELECT candidate::INTEGER AS step, round(t.train_loss, 6) AS train_loss, {models.ROUNDED}, candidate = (SELECT step FROM best_step) AS is_best
FROM history JOIN (SELECT step, avg(loss) AS train_loss FROM steps WHERE split = 'train' GROUP BY step) t ON t.step = candidate
WHERE candidate <= (SELECT step FROM last_step)"""


def _predictions_sql(setup: dict) -> str:
    return f"""{_steps_sql(**setup)}
SELECT row_id, label, prediction::BIGINT AS prediction, round(probability, 6) AS probability FROM steps WHERE split = 'test' AND step = (SELECT step FROM best_step)"""


def _run(spark, folder, setup: dict):
    emb = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", F.col("label").cast("bigint").alias("label"))
    rows = cut_lineage(split.split_80_10_10(emb, "label", "row_id"))
    shape = rows.agg(F.max(F.size("embedding")), F.max("label")).first()
    return rows, steps.fit_steps(rows, "embedding", "label", shape[1] + 1, shape[0], **setup)


def _history(spark, folder, setup: dict):
    _, run = _run(spark, folder, setup)
    return models.rounded(run.history).withColumn("train_loss", F.round("train_loss", 6))


def _predictions(spark, folder, setup: dict):
    """The best step, stored as a table, read back and applied to the part that no step has seen."""
    rows, run = _run(spark, folder, setup)
    layers = steps.load_layers(steps.save_layers(spark, run.layers, scratch_path(spark, "head")))
    test = rows.filter("split = 'test'")
    found = steps.predict_steps(test, "row_id", "embedding", layers)
    return test.select("row_id", "label").join(found, "row_id").withColumn("probability", F.round("probability", 6))


@query("step_history_linear", _history_sql(LINEAR))
def step_history_linear(spark, folder):
    return _history(spark, folder, LINEAR)


@query("step_history_layered", _history_sql(LAYERED))
def step_history_layered(spark, folder):
    return _history(spark, folder, LAYERED)


@query("step_best_linear", _predictions_sql(LINEAR))
def step_best_linear(spark, folder):
    return _predictions(spark, folder, LINEAR)


@query("step_best_layered", _predictions_sql(LAYERED))
def step_best_layered(spark, folder):
    return _predictions(spark, folder, LAYERED)
