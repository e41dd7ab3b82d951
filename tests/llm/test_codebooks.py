"""Codebooks against plain k-means in whole numbers."""

import hashlib
from math import floor

import numpy as np
import pytest

from corpuscat.llm import codebooks as module
from corpuscat.llm.codebooks import Books, assign, compress, limit, with_label_error

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, _n bigint"


def plain(rows, parts=8, entries=16, rounds=6):
    """id -> code, error, and the digest, by comparing every piece with every entry."""
    kept = [(i, [floor(4096 * float(np.float32(x))) for x in v], n) for n, (i, v, *_) in enumerate(rows) if v is not None and None not in v and np.isfinite(v).all()]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(rows[r[2]][1], np.float32).tobytes()))
    length = len(kept[0][1]) // parts
    piece = lambda v, p: v[p * length : (p + 1) * length]
    books = [[piece(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    choose = lambda v: [min(range(len(books[p])), key=lambda e: (far(piece(v, p), books[p][e]), e)) for p in range(parts)]
    for _ in range(rounds):
        codes = [choose(v) for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [piece(v, p) for (_, v, _), c in zip(kept, codes) if c[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for i, v, _ in kept:
        code = choose(v)
        out.append((i, "".join(f"{c:02x}" for c in code), sum(far(piece(v, p), books[p][c]) for p, c in enumerate(code))))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def check(spark, rows, parts=5, stats=None):
    got = compress(spark.createDataFrame(rows, SCHEMA).repartition(parts), stats=stats).collect()
    want, digest = plain(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got), key=key) == sorted(want, key=key)
    assert {r["codebooks_sha256"] for r in got} == {digest}
    return got


@pytest.mark.parametrize("block", [4_096, 37])
def test_equals_plain_k_means(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.2 * rng.standard_normal(16)).tolist(), i % 3, "x", 1) for i in range(400)]
    stats = []
    check(spark, rows, stats=stats)
    full = 400 * 8 * 16
    assert stats[0] <= full and stats[-1] < full / 2  # cores and rings leave out most distances


def test_few_coarse_and_repeated_vectors(spark):
    """Ties everywhere: components of few values, copies, fewer vectors than entries, repeated and null ids."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-1, 2, 16) / 2).tolist(), None, "x", 1) for i in range(150)]
    rows += [(3, rows[3][1], 1, "x", 1), (3, rows[4][1], 1, "x", 1), (None, rows[9][1], 1, "x", 1)]
    check(spark, rows)
    check(spark, rows[:5])
    check(spark, [(i, [0.0] * 8, 0, "x", 1) for i in range(40)])


def test_skipped_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.standard_normal(8).tolist(), i % 2, "x", 1) for i in range(1, 31)]
    bad = [(0, None, 1, "x", 1), (0, [1.0] * 7 + [None], 1, "x", 1), (0, [float("nan")] * 8, 1, "x", 1), (0, [float("-inf")] * 8, 1, "x", 1)]
    check(spark, good + bad)
    odd = [(90, [1.0] * 16, 1, "x", 1), (91, [], 1, "x", 1), (92, [1.0] * 3, None, "x", 1), (-5, [1e30] * 8, 1, "x", 1)]
    got = {r["vec_id"]: r for r in compress(spark.createDataFrame(good + bad + odd, SCHEMA)).collect()}
    assert len(got) == 34 and all(got[i]["code"] is None and got[i]["error"] is None for i in (90, 91, 92, -5))
    want, digest = plain(good)
    assert {(i, got[i]["code"], got[i]["error"]) for i, *_ in good} == set(want) and got[90]["codebooks_sha256"] == digest
    only = compress(spark.createDataFrame(odd[1:], SCHEMA)).collect()
    assert len(only) == 3 and not any(r["code"] or r["codebooks_sha256"] for r in only)
    assert compress(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("max_bytes", [0, 1 << 26])
def test_label_errors(spark, monkeypatch, max_bytes):
    monkeypatch.setattr(module, "lookup", lambda *a, **k: __import__("corpuscat.operators.scale", fromlist=["lookup"]).lookup(*a, **k, max_bytes=max_bytes))
    rows = [(i, None if i % 7 == 0 else i % 2, "c", None if i % 11 == 5 else i) for i in range(100)]
    got = with_label_error(spark.createDataFrame(rows, "vec_id int, label int, code string, error bigint"))
    assert got.columns == ["vec_id", "label", "code", "error", "label_error"]
    sums = {}
    for _, label, _, error in rows:
        sums[label] = sums.get(label, 0) + (error or 0)
    assert got.count() == 100 and all(r["label_error"] == sums[r["label"]] for r in got.collect())


def test_large_components():
    """Distances stay exact up to the limit."""
    most = limit(8)
    x = np.array([[most] * 8, [-most] * 8, [0] * 8], np.int64)
    entries = np.array([[[-most]], [[most]]] * 4).reshape(8, 1, 1)
    books = Books(np.concatenate([entries, -entries], axis=1), np.ones((8, 2), bool))
    codes, _, _ = assign(x, np.zeros((3, 8), np.uint8), None, books)
    want = [[min((0, 1), key=lambda e: ((int(v) - int(books.entries[p, e, 0])) ** 2, e)) for p, v in enumerate(row)] for row in x]
    assert codes.tolist() == want
    assert int(((x[0, 0] - x[1, 0]) * 2) ** 2 * 8) == (2 * 2 * most) ** 2 * 8 < 1 << 63


def test_rounds_drop_the_round_before(spark):
    from corpuscat.session import scratch_root

    rng = np.random.default_rng(1)
    compress(spark.createDataFrame([(i, rng.standard_normal(8).tolist(), 0, "x", 1) for i in range(50)], SCHEMA)).count()
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    names = [f.getPath().getName() for f in jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(jvm)]
    assert len([n for n in names if n.startswith("blocks-")]) <= 20  # one for each call so far, not one for each round
