"""Vector links against all pairs in numpy."""

import math
from collections import Counter

import numpy as np
import pytest

from corpuscat.llm import vectors as module
from corpuscat.llm.vectors import link_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, kept string"


def brute(rows, similar=0.93):
    """id -> (links, component) of all pairs in double precision."""
    good = [(i, np.array(v, np.float32).astype(float), l) for i, v, l, *_ in rows if i is not None and l is not None and v is not None and None not in v]
    good = [(i, v / np.linalg.norm(v), l) for i, v, l in good if len(v) and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    links, up = Counter(), {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, (i, v, l) in enumerate(good):
        for j, w, k in good[:a]:
            if l == k and len(v) == len(w) and v @ w >= similar:
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                if x != y:
                    up[max(x, y)] = min(x, y)
    return {i: (links[i], root(i)) for i, *_ in rows}


def near(rng, base, angle):
    d = rng.standard_normal(len(base))
    d -= d @ base * base
    return math.cos(angle) * base + math.sin(angle) * d / np.linalg.norm(d)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(rng.standard_normal(24))
    out, i = [], 0
    for label in range(3):
        for _ in range(150):
            out.append((i, unit().tolist(), label, "x"))
            i += 1
        for size in (2, 3, 30, 60):  # chains and dense groups, larger than a list
            base = unit()
            for _ in range(size):
                out.append((i, (near(rng, base, 0.17 + 0.1 * rng.random()) * 3).tolist(), label, "x"))
                i += 1
    out += [(i + k, out[0][1], 0, "copy") for k in range(40)]
    return out


def test_against_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 16)
    want = brute(rows)
    got = {r["vec_id"]: r for r in link_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert len(got) == len(rows)
    found, true = sum(min(r["n_links"], want[i][0]) for i, r in got.items()), sum(n for n, _ in want.values())
    assert all(r["n_links"] <= want[i][0] for i, r in got.items())
    assert found / true >= 0.99
    assert sum(got[i]["component_id"] == want[i][1] for i in got) / len(got) >= 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


@pytest.mark.parametrize("linked", [64, 10**9])
def test_few_links_among_many_vectors(spark, monkeypatch, linked):
    """Isolated pairs are found by search, and by all pairs where the audit has too few to judge by."""
    monkeypatch.setattr(module, "CELL", 4)
    if linked > 64:
        monkeypatch.setattr(module, "AUDIT_LINKED", linked)
        monkeypatch.setattr(module, "AUDIT_MOST", 512)
        monkeypatch.setattr(module, "AUDIT_BYTES", 1)
        monkeypatch.setattr(module, "ALL_BLOCK", 200)
    rng = np.random.default_rng(11)
    rows = [(i, rng.standard_normal(48).tolist(), 0, "x") for i in range(1_500)]
    for i in range(80):
        base = np.array(rows[i][1])
        rows.append((1_500 + i, near(rng, base / np.linalg.norm(base), 0.37).tolist(), 0, "x"))
    want = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in link_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    right = sum(got[i] == want[i] for i in got if want[i][0])
    assert right >= (160 if linked > 64 else 157) and all(got[i] == want[i] for i in got if not want[i][0])


EDGE = [
    (1, [1.0, 0.0], 1, "a"), (2, [2.0, 0.0], 1, "a"), (3, [1.0, 0.0], 2, "a"), (4, [1.0, 0.0], None, "a"), (5, None, 1, "a"), (6, [0.0, 0.0], 1, "a"),
    (7, [1.0, None], 1, "a"), (8, [float("nan"), 1.0], 1, "a"), (9, [float("inf"), 1.0], 1, "a"), (10, [], 1, "a"), (11, [1.0, 0.0, 0.0], 1, "a"),
    (12, [1.0, 0.0], 1, "a"), (12, [1.0, 0.0], 1, "a"), (None, [1.0, 0.0], 1, "a"),
]


def test_edges(spark):
    got = link_vectors(spark.createDataFrame(EDGE, SCHEMA)).collect()
    assert len(got) == len(EDGE)
    by = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert by[1] == by[2] == by[12] == (3, 1)
    assert all(by[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, None))
    assert link_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
