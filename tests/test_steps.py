import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscat.operators import steps

SCHEMA = "id int, x array<double>, label int, split string"


def parted(spark, n=120, classes=3):
    """Points around one corner for each class, dealt over the parts."""
    draw = np.random.default_rng(5)
    rows = []
    for i in range(n):
        c = i % classes
        centre = np.zeros(4)
        centre[c] = 3.0
        rows.append((i, (centre + draw.normal(size=4) * 0.3).tolist(), c, ("train", "train", "val", "test")[i // classes % 4]))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("hidden", [0, 5])
def test_gradient_is_the_slope_of_the_loss(hidden):
    draw = np.random.default_rng(3)
    x, y = draw.normal(size=(7, 4)), draw.integers(0, 3, 7)
    layers = [w + draw.normal(size=w.shape) * 0.1 for w in steps.start_layers(4, 3, hidden)]

    def loss():
        _, p = steps.forward(x, layers)
        return -np.log(p[np.arange(7), y]).sum()

    given, p = steps.forward(x, layers)
    for w, g in zip(layers, steps.backward(given, p, y, layers)):
        for at in np.ndindex(*w.shape):
            w[at] += 1e-6
            up = loss()
            w[at] -= 2e-6
            down = loss()
            w[at] += 1e-6
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5


@pytest.mark.parametrize("hidden", [0, 6])
def test_learns_and_stored_head_predicts_alike(spark, tmp_path, hidden):
    rows = parted(spark)
    run = steps.fit_steps(rows, "x", "label", 3, 4, hidden=hidden, steps=25, rate=0.5, patience=25)
    history = run.history.orderBy("step").collect()
    losses = [r["train_loss"] for r in history]
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0] / 2
    assert [r["step"] for r in history if r["is_best"]] == [run.best]
    top = max(r["accuracy"] for r in history)
    assert run.best == min(r["step"] for r in history if r["accuracy"] == top)
    again = steps.load_layers(steps.save_layers(spark, run.layers, str(tmp_path / "head")))
    assert all((a == b).all() for a, b in zip(run.layers, again))
    test = rows.filter("split = 'test'")
    found = test.join(steps.predict_steps(test, "id", "x", again), "id")
    assert found.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] == 1.0


def test_dealing_rows_differently_changes_nothing(spark):
    rows = parted(spark)
    one = steps.fit_steps(rows.coalesce(1), "x", "label", 3, 4, steps=4, patience=9)
    many = steps.fit_steps(rows.repartition(7), "x", "label", 3, 4, steps=4, patience=9)
    assert one.best == many.best and np.allclose(one.layers[0], many.layers[0], atol=1e-12)


def test_stops_after_steps_without_gain(spark):
    rows = parted(spark).withColumn("x", F.array(*[F.lit(1.0)] * 4))  # nothing to learn
    run = steps.fit_steps(rows, "x", "label", 3, 4, steps=20, patience=2)
    assert [r["step"] for r in run.history.orderBy("step").collect()] == [0, 1, 2] and run.best == 0


def test_rows_that_take_no_part(spark):
    rows = parted(spark)
    odd = [(900, None, 0, "train"), (901, [1.0, 2.0], 0, "train"), (902, [1.0, None, 0.0, 0.0], 0, "val"), (903, [float("nan")] * 4, 0, "train"),
           (904, [float("inf"), 0.0, 0.0, 0.0], 1, "train"), (905, [1.0] * 4, None, "train"), (906, [1.0] * 4, 3, "val"), (907, [1.0] * 4, -1, "train"),
           (908, [1.0] * 4, 1, None)]
    more = rows.unionByName(spark.createDataFrame(odd, SCHEMA))
    a = steps.fit_steps(rows, "x", "label", 3, 4, steps=3, patience=9)
    b = steps.fit_steps(more, "x", "label", 3, 4, steps=3, patience=9)
    assert np.allclose(a.layers[0], b.layers[0], atol=1e-12)
    asked = more.filter("id >= 900")
    assert sorted(r["id"] for r in steps.predict_steps(asked, "id", "x", b.layers).collect()) == [905, 906, 907, 908]


def test_empty_parts(spark):
    rows = parted(spark)
    none = steps.fit_steps(rows.limit(0), "x", "label", 3, 4)
    assert none.best == 0 and [r["accuracy"] for r in none.history.collect()] == [None]
    unjudged = steps.fit_steps(rows.filter("split = 'train'"), "x", "label", 3, 4, steps=9, patience=2)
    assert unjudged.best == 0 and not unjudged.layers[0].any()
    assert steps.predict_steps(rows.limit(0), "id", "x", unjudged.layers).count() == 0
