"""Heads over given vectors, trained step by step with a validated history; the best step is kept.

A step is one gradient of the whole training part. Each task sums its rows' gradients and
counts, sums meet by their place in the model, and the driver gets one number for each
weight and for each (label, prediction) that occurs, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscat.operators.evaluate import metrics
from corpuscat.session import cut_lineage
from corpuscat.sources.stored import save_table

FLOOR = 1e-15  # of a probability under the loss
_TRAIN_LOSS, _TRAIN_ROWS, _VAL_LOSS, _VAL_ROWS, _COUNTS = range(5)  # places after those of the weights

Layers = list[np.ndarray]


@dataclass(frozen=True)
class StepRun:
    """The best step's layers, its number, and one row of ``history`` for each step."""

    layers: Layers
    best: int
    history: DataFrame


def start_layers(width: int, classes: int, hidden: int = 0) -> Layers:
    """Zeros for a linear head; small weights by a rule where units must differ, biases at 0."""
    if not hidden:
        return [np.zeros((classes, width + 1))]

    def layer(units: int, inputs: int) -> np.ndarray:
        unit, place = np.arange(units)[:, None], np.arange(inputs + 1)[None, :]
        return np.where(place == 0, 0.0, ((37 * unit + 17 * place + unit * place) % 101 - 50) / 250.0)

    return [layer(hidden, width), layer(classes, hidden)]


def forward(x: np.ndarray, layers: Layers) -> tuple[list[np.ndarray], np.ndarray]:
    """What each layer is given, with a leading 1, and the class probabilities of the rows of ``x``."""
    given = []
    for i, w in enumerate(layers):
        x = np.hstack([np.ones((len(x), 1)), np.maximum(x, 0.0) if i else x])
        given.append(x)
        x = x @ w.T
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return given, p / p.sum(axis=1, keepdims=True)


def backward(given: list[np.ndarray], p: np.ndarray, y: np.ndarray, layers: Layers) -> Layers:
    """Gradient of the summed log loss for each layer."""
    back = p.copy()
    back[np.arange(len(y)), y] -= 1.0
    out: Layers = []
    for i in reversed(range(len(layers))):
        out.insert(0, back.T @ given[i])
        if i:
            back = (back @ layers[i][:, 1:]) * (given[i][:, 1:] > 0)
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _own_loss(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    return -np.log(np.maximum(p[np.arange(len(y)), y], FLOOR))


def _sums(layers: Layers, width: int, classes: int):
    """One task's ``place, value``: gradients and loss of its training rows, loss and counts of the others."""
    weights = sum(w.size for w in layers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grads = [np.zeros_like(w) for w in layers]
        facts, counts = np.zeros(_COUNTS), {}
        for batch in batches:
            x, y, fits = _matrix(batch.column(0), width), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            if not len(y):
                continue
            given, p = forward(x, layers)
            for total, g in zip(grads, backward([a[fits] for a in given], p[fits], y[fits], layers)):
                total += g
            loss = _own_loss(p, y)
            facts += [loss[fits].sum(), fits.sum(), loss[~fits].sum(), (~fits).sum()]
            places, n = np.unique(y[~fits] * classes + p[~fits].argmax(axis=1), return_counts=True)
            for place, k in zip(places.tolist(), n.tolist()):
                counts[place] = counts.get(place, 0) + k
        place = np.concatenate([np.arange(weights + _COUNTS), np.array(list(counts), np.int64) + weights + _COUNTS])
        value = np.concatenate([*[g.ravel() for g in grads], facts, np.array(list(counts.values()), np.float64)])
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(value, pa.float64())], names=["place", "value"])

    return run


def _usable(features: str, width: int) -> Column:
    sound = F.forall(features, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(features) == width) & sound, F.lit(False))


def fit_steps(
    rows: DataFrame,
    features: str,
    label: str,
    classes: int,
    width: int,
    hidden: int = 0,
    steps: int = 20,
    rate: float = 1.0,
    patience: int = 3,
    part: str = "split",
) -> StepRun:
    """Train on the rows of part ``train``, judge every step on part ``val``, keep the best.

    A linear softmax head, or one with a layer of ``hidden`` rectified units. Step 0 is the
    start; each later one goes ``rate`` times the mean gradient downhill from the step
    before. The best has the highest accuracy on ``val`` (the micro F1 of single labels),
    the first on a tie. Training ends ``patience`` steps after the best, at most after ``steps``.
    ``history`` has ``step, train_loss``, the metrics on ``val`` and ``is_best``.

    A step is one pass over a stored table of vectors and labels. Sums hold no order, so
    runs agree up to the rounding of doubles. Rows take no part whose vector is null, of
    another width or holds null or non-finite components, or whose label is null or not in
    0 to ``classes`` - 1; repeated rows count each. Without training rows nothing moves,
    without validation rows step 0 is the best and its metrics are null.
    """
    known = F.coalesce(F.col(label).between(0, classes - 1), F.lit(False))
    slim = rows.filter(F.col(part).isin("train", "val") & known & _usable(features, width))
    slim = cut_lineage(slim.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("bigint").alias("y"), (F.col(part) == "train").alias("fits")))
    layers = start_layers(width, classes, hidden)
    weights = sum(w.size for w in layers)
    best, best_layers, reached = 0, layers, -1.0
    facts, cells = [], []
    for step in range(steps + 1):
        found = slim.mapInArrow(_sums(layers, width, classes), "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        at = {r["place"]: r["value"] for r in found}
        one = [at.get(weights + k, 0.0) for k in range(_COUNTS)]
        counts = {p - weights - _COUNTS: int(v) for p, v in at.items() if p >= weights + _COUNTS}
        cells += [(step, p // classes, p % classes, n) for p, n in sorted(counts.items())]
        mean = [one[s] / one[n] if one[n] else None for s, n in ((_TRAIN_LOSS, _TRAIN_ROWS), (_VAL_LOSS, _VAL_ROWS))]
        facts.append((step, *mean))
        right = sum(n for p, n in counts.items() if p // classes == p % classes)
        accuracy = right / one[_VAL_ROWS] if one[_VAL_ROWS] else 0.0
        if accuracy > reached:
            best, best_layers, reached = step, layers, accuracy
        if step - best >= patience or not one[_TRAIN_ROWS]:
            break
        flat, start, moved = np.array([at.get(p, 0.0) for p in range(weights)]), 0, []
        for w in layers:
            moved.append(w - rate * flat[start : start + w.size].reshape(w.shape) / one[_TRAIN_ROWS])
            start += w.size
        layers = moved
    spark = rows.sparkSession
    losses = spark.createDataFrame(facts, "step int, train_loss double, log_loss double")
    scores = metrics(spark.createDataFrame(cells, "step int, label bigint, prediction bigint, n bigint"), ["step"])
    return StepRun(best_layers, best, losses.join(F.broadcast(scores), "step", "left").withColumn("is_best", F.col("step") == best))


def save_layers(spark: SparkSession, layers: Layers, path: str) -> DataFrame:
    """The head as a table ``layer, unit, place, weight``; place 0 is the bias."""
    cells = [(k, u, p, float(v)) for k, w in enumerate(layers) for (u, p), v in np.ndenumerate(w)]
    return save_table(spark.createDataFrame(cells, "layer int, unit int, place int, weight double"), path)


def load_layers(table: DataFrame) -> Layers:
    """The layers of a stored table, which has one row for each weight."""
    cells = table.collect()
    out = []
    for k in range(max((r["layer"] for r in cells), default=-1) + 1):
        own = [r for r in cells if r["layer"] == k]
        w = np.zeros((max(r["unit"] for r in own) + 1, max(r["place"] for r in own) + 1))
        for r in own:
            w[r["unit"], r["place"]] = r["weight"]
        out.append(w)
    return out


def predict_steps(rows: DataFrame, row_id: str, features: str, layers: Layers) -> DataFrame:
    """``row_id, prediction, probability`` of each row with a usable vector; ties go to the lowest label."""
    width = layers[0].shape[1] - 1
    kind = rows.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, p = forward(_matrix(batch.column(1), width), layers)
            best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
            columns = [batch.column(0), pa.array(best, pa.int64()), pa.array(p[np.arange(len(p)), best], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "prediction", "probability"])

    slim = rows.filter(_usable(features, width)).select(F.col(row_id).alias("id"), F.col(features).cast("array<double>").alias("x"))
    return slim.mapInArrow(run, f"id {kind}, prediction bigint, probability double").withColumnRenamed("id", row_id)
