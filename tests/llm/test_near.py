"""Near copies against all pairs of shingle sets."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from corpuscat.llm import near as module
from corpuscat.llm.links import connected
from corpuscat.llm.near import compare, drop_near, near_classes, shingles, signatures

SCHEMA = "doc_id bigint, text string, class_id string, kept string"


def words(t):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())


def shingle_set(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def weights(t):
    """A shingle weighs 1, and 1 more for each doubling of its count."""
    w = words(t)
    counts = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    return {s: n.bit_length() for s, n in counts.items()}


def similar(a, b, plain=False):
    if plain:
        a, b = dict.fromkeys(a, 1), dict.fromkeys(b, 1)
    low = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return low >= 0.8 * (sum(a.values()) + sum(b.values()) - low)


def brute(rows):
    sets = [(i, weights(t)) for i, t, *_ in rows if i is not None]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, r in sets[:a]:
            if s and r and (similar(s, r, plain=True) or similar(s, r)):
                x, y = root(i), root(j)
                if x != y:
                    up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def edited(rng, base, n):
    w = list(base)
    for k in rng.sample(range(len(w)), n):
        w[k] = f"new{rng.randint(0, 10**9)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{k}é" for k in range(900)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out = []
    shared = " ".join(text(40))
    for _ in range(80):
        out.append(" ".join(text(rng.randint(1, 150))))
        out.append(f"{shared} {' '.join(text(60))}")  # a common passage makes no near copy
    for size, n in ((2, 90), (5, 200), (40, 120), (160, 150)):
        base = text(n)
        out.append(" ".join(base))
        out += [edited(rng, base, rng.randint(0, max(1, n // 25))) for _ in range(size)]
    base = text(100)
    chain = [list(base)]
    for _ in range(6):  # each near the next, the ends not near each other
        chain.append(edited(rng, chain[-1], 2).split())
    out += [" ".join(c) for c in chain]
    rng.shuffle(out)
    return [(i, t, "c", "k") for i, t in enumerate(out)]


@pytest.mark.parametrize("block,bucket", [(512, 256), (16, 8)])
def test_classes(spark, rows, monkeypatch, block, bucket):
    monkeypatch.setattr(module, "BLOCK_TEXTS", block)
    monkeypatch.setattr(module, "BUCKET", bucket)
    got = {r["doc_id"]: r["class_id"] for r in near_classes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == brute(rows)


def test_copies_that_repeat_a_line_more_often(spark):
    rng = random.Random(9)
    rows = []
    for k in range(24):
        base, line = [f"b{k}x{rng.randint(0, 10**9)}" for _ in range(400)], [f"line{k}", "of", "five", "words", f"end{k}"]
        for times in (1, 3, 30, 100, 400):
            at = rng.randint(0, 400)
            rows.append((len(rows), " ".join(base[:at] + line * times + base[at:]), "c", "k"))
    want = brute(rows)
    assert len(set(want.values())) == 24
    assert {r["doc_id"]: r["class_id"] for r in near_classes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()} == want


def test_copies_that_differ_beside_lines_that_repeat(spark):
    """Alike by weight alone: most of each text is lines said several times, the rest is its own."""
    rng = random.Random(4)
    rows = []
    for k in range(20):
        lines = " ".join(" ".join([f"l{k}x{i}", "of", f"m{i}", "words", f"end{k}"] * 8) for i in range(30))
        for _ in range(4):
            rows.append((len(rows), f"{lines} {' '.join(f'u{rng.randint(0, 10**9)}' for _ in range(55))}", "c", "k"))
    a, b = weights(rows[0][1]), weights(rows[1][1])
    assert similar(a, b) and not similar(a, b, plain=True)
    want = brute(rows)
    assert len(set(want.values())) == 20
    assert {r["doc_id"]: r["class_id"] for r in near_classes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()} == want


def test_compare_equals_plain_weights(rows):
    rng = random.Random(8)
    texts = [t for _, t, *_ in rows[:60]]
    texts += [" ".join(rng.choice(texts[k].split()) for _ in range(3)) + " " + " ".join([texts[k]] * rng.randint(1, 5)) for k in range(40)]
    every = np.arange(len(texts))
    i, j = compare(texts, every, every)
    sets = [weights(t) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(len(texts)) if a != b and sets[a] and sets[b] and (similar(sets[a], sets[b], plain=True) or similar(sets[a], sets[b]))}
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a != b} == want and want


EDGE = [(1, None, "c", "k"), (2, "", "c", "k"), (3, "!!! ...", "c", "k"), (4, "a b", "c", "k"), (5, "A, b!", "c", "k"), (6, "b a", "c", "k"), (7, "x " * 60_000 + "end", "c", "k"),
        (8, "x " * 60_000 + "end.", "c", "k"), (9, "one two three four five", "c", "k"), (9, "one two three four five", "c", "k"), (10, "one two three four five", "c", "k"),
        (None, "one two three four five", "c", "k")]


def test_edges(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    got = near_classes(df).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert by == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, 10: 9, None: None}
    out = drop_near(df)
    assert out.columns == df.columns
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in out.collect()) == [-1, 1, 2, 3, 4, 6, 7, 9, 9]
    empty = spark.createDataFrame([], SCHEMA)
    assert near_classes(empty).count() == 0 and drop_near(empty).count() == 0


def test_shingles_are_those_of_plain_python(rows):
    texts = [t for _, t, *_ in rows] + ["", "a", "a b c d", "Ab, aB; AB ab ab ab"]
    d, h, n, _ = shingles(texts)
    assert np.bincount(d, minlength=len(texts)).tolist() == [len(shingle_set(t)) for t in texts]
    assert n.sum() == sum(max(1, len(words(t)) - 4) for t in texts if words(t))


def test_registers_estimate_the_probability_jaccard():
    """Agreement of registers is sum over x of 1 / sum over y of max(a_y/a_x, b_y/b_x)."""
    rng = np.random.default_rng(2)
    element = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    a, b = rng.integers(1, 6, 60).astype(float), rng.integers(1, 6, 60).astype(float)
    a[:15], b[45:] = 0, 0
    true = sum(1 / np.maximum(a / a[x], b / b[x]).sum() for x in range(15, 45))
    agree = []
    for k in range(60):
        h = element * np.uint64(2 * k + 1)
        text = np.repeat([0, 1], [45, 45])
        r = signatures(2, text, np.concatenate([h[15:], h[:45]]), np.concatenate([a[15:], b[:45]]))
        agree.append((r[0] == r[1]).mean())
    assert np.mean(agree) == pytest.approx(true, abs=0.02)


def test_compare_takes_the_threshold_in():
    a = [f"t{k}" for k in range(22)]
    b = [*a[:20], "u", "v"]
    assert len(shingle_set(" ".join(a)) & shingle_set(" ".join(b))) / len(shingle_set(" ".join(a)) | shingle_set(" ".join(b))) == 0.8
    i, j = compare([" ".join(a), " ".join(b)], np.array([0]), np.array([1]))
    assert i.tolist() == [0] and j.tolist() == [1]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 800)] + [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(120)] + [(1, 1), (2, None), (7, 5), (7, 5)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    ids = {x for a, b in pairs if b is not None and a != b for x in (a, b)}
    got = {r["id"]: r["component"] for r in connected(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in ids}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_drop_near_with_columns_of_its_own_names(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "a", 5), (2, words + " more", "b", 1), (2, words + " more", "b", 1), (3, "other words altogether here now", "c", 1), (3, "other words altogether here now", "c", 1), (None, words, "d", 2), (4, None, "e", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _near_id string, _NEAR_ID_ int")
    kept = drop_near(docs)
    assert kept.columns == docs.columns
    assert sorted(r["_near_id"] for r in kept.collect()) == ["a", "c", "c", "d", "e"]
