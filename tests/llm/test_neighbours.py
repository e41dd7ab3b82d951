"""Nearest neighbours against all pairs in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscat.llm import neighbours as module
from corpuscat.llm.neighbours import inner, nearest, quantised, recall, tile_products

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, rank int, cell string"


def asks():
    return F.col("vec_id") % 20 == 0


def brute(rows, k, kind=np.float32):
    """query row -> ids and scores of the k best others, by plain loops over the components."""
    good = [(n, r[0], np.array(r[1], kind).astype(float)) for n, r in enumerate(rows) if r[0] is not None and r[1] and None not in r[1]]
    good = [g for g in good if np.isfinite(g[2]).all() and g[2].any()]
    out = []
    for n, i, v in good:
        if i % 20:
            continue
        scored = []
        for m, j, w in good:
            if m != n and len(v) == len(w):
                total = 0.0
                for x, y in zip(v.tolist(), w.tolist()):
                    total += x * y
                scored.append((-total, j))
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def answers(spark, rows, k, schema=SCHEMA, parts=4):
    got = nearest(spark.createDataFrame(rows, schema).repartition(parts), asks(), k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("block,tile", [(2_048, 1_024), (7, 5)])
def test_equals_all_pairs(spark, monkeypatch, block, tile):
    monkeypatch.setattr(module, "BLOCK_ROWS", block)
    monkeypatch.setattr(module, "BLOCK_BYTES", 8 * 24 * block)
    monkeypatch.setattr(module, "TILE", tile)
    monkeypatch.setattr(module, "RUN_ROWS", 40)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(24) * 10.0 ** rng.integers(-3, 3)).tolist(), 0, "x", 1, "y") for i in range(900)]
    assert answers(spark, rows, 20) == brute(rows, 20)


def test_copies_and_ties(spark):
    """One vector that a third of the rows repeat: ties go to smaller ids, the own row is left out."""
    rng = np.random.default_rng(8)
    hot = rng.standard_normal(16).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.standard_normal(16).tolist(), 0, "x", 1, "y") for i in range(400)]
    assert answers(spark, rows, 20) == brute(rows, 20)


EDGE = [
    (0, [1.0, 2.0], 1, None, None, None), (1, [2.0, 1.0], None, "a", 1, "c"), (2, None, 1, "a", 1, "c"), (3, [0.0, 0.0], 1, "a", 1, "c"), (4, [1.0, None], 1, "a", 1, "c"),
    (5, [float("nan"), 1.0], 1, "a", 1, "c"), (6, [float("inf"), 1.0], 1, "a", 1, "c"), (7, [], 1, "a", 1, "c"), (8, [1.0, 2.0, 3.0], 1, "a", 1, "c"), (None, [9.0, 9.0], 1, "a", 1, "c"),
    (20, [-1.0, 0.5], 1, "a", 1, "c"), (20, [-1.0, 0.5], 1, "a", 1, "c"), (20, [3.0, -0.0], 1, "a", 1, "c"), (40, [1.0, 1.0, 1.0], 1, "a", 1, "c"), (60, [5.0], 1, "a", 1, "c"),
    (80, [0.0, 0.0], 1, "a", 1, "c"), (9, [1e-42, 1e-45], 1, "a", 1, "c"),
]


def test_edges(spark):
    """Unusable vectors and rows without ids take no part; few candidates give few rows; ids may repeat."""
    got = answers(spark, EDGE, 20)
    assert got == brute(EDGE, 20)
    assert not [r for r in got if r[0] in (60, 80)]


def test_doubles_strings_and_no_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(f"k{i:03}", rng.standard_normal(5).tolist()) for i in range(60)] + [("big", [1e300, -1e300, 0.0, 0.0, 1.0]), ("k_big", [1e300, 1e300, 0.0, 0.0, 1.0])]
    schema = "vec_id string, embedding array<double>"
    got = nearest(spark.createDataFrame(rows, schema), F.col("vec_id").isin("k000", "k007"), 5).collect()
    for q in ("k000", "k007"):
        v = np.array(dict(rows)[q])
        want = sorted((-inner(v[None], np.array(w)[None])[0], i) for i, w in rows if i != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in got if r["query_id"] == q] == want
    huge = nearest(spark.createDataFrame(rows, schema), F.col("vec_id") == "big", 70).collect()
    assert len(huge) == 61 and huge[-1]["vec_id"] == "k_big" and huge[-1]["score"] == -np.inf  # inf - inf
    empty = spark.createDataFrame([], SCHEMA)
    assert nearest(empty, asks()).count() == 0
    assert nearest(spark.createDataFrame(EDGE[1:2], SCHEMA), asks()).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((50, 1_500)) * 100, rng.standard_normal((60, 1_500))
    ca, sa, ra, na = quantised(a)
    cb, sb, rb, nb = quantised(b)
    assert (tile_products(ca, cb) == ca.astype(np.int64) @ cb.astype(np.int64).T).all()
    off = np.abs(a @ b.T - tile_products(ca, cb) * sa[:, None] * sb)
    assert (off <= na[:, None] * rb + ra[:, None] * (nb + rb) + 1e-9).all()


def test_recall_measure(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(200)], "vec_id bigint, embedding array<float>")
    found = nearest(df, asks(), 5)
    assert recall(df, found, asks(), 5) == 1.0
    assert recall(df, found.filter("rank <= 3"), asks(), 5) == pytest.approx(0.6)
