"""Mixing against targets filled up in plain Python."""

import re
from collections import Counter

import pytest
from conftest import SF

from corpuscat.llm.mixing import choose_copies, mix_documents, word_count

SCHEMA = "doc_id bigint, text string, source string, size string"


def targets(sizes):
    """The rounds of the contract: cap, reshare by weight, until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    total = 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def words(n, tag):
    return " ".join(f"{tag}{k}" for k in range(n))


@pytest.fixture(scope="module")
def rows():
    out, i = [], 0
    for s, n in (("a", 400), ("b", 60), ("B", 90), ("é", 40), (None, 80), ("c", 1), ("none", 3)):
        for k in range(n):
            size = 0 if s == "none" else 5 + (k * k * 7) % 180
            out.append((i, words(size, "w") if size else (None if k % 2 else " \n"), s, "x"))
            i += 1
    return [*out, (3, out[3][1], "a", "x"), (None, "one two", "b", "y")]


def test_targets_and_shares(spark, rows):
    got = choose_copies(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    size_of, source_of = Counter(), {}
    for i, t, s, _ in rows:
        size_of[s] += len((t or "").split())
        source_of.setdefault(i, s)
    want = targets(dict(size_of))
    taken = Counter()
    for r in got:
        s = "b" if r["doc_id"] is None else source_of[r["doc_id"]]
        assert r["source_size"] == size_of[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["size"] * r["copies"]
        taken[s] += r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 12 if s != "c" else want[s]), (s, taken[s], want[s])


def test_reruns_agree_and_copies_take_effect(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, choose_copies(df).fillna(-1).collect()))
    assert one == sorted(map(tuple, choose_copies(df.repartition(3)).fillna(-1).collect()))
    copies = Counter()
    for r in one:
        copies[r[0]] += r[4]
    mix = mix_documents(df)
    assert mix.columns == df.columns
    assert Counter(-1 if r["doc_id"] is None else r["doc_id"] for r in mix.collect()) == +copies


def test_expected_copies(spark):
    """Over seeds, each of some equal documents is taken as often as its share says."""
    rows = [(i, words(20, "w"), "a", "") for i in range(9)] + [(9 + i, words(20, "w"), "b", "") for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    total = Counter()
    for seed in range(6):
        for r in choose_copies(df, seed=seed).collect():
            total[r["doc_id"]] += r["copies"]
    assert sum(total.values()) == pytest.approx(6 * 27, abs=6)
    assert all(3 <= total[i] <= 12 for i in range(18))


def test_word_count(spark):
    texts = ["", " ", None, "a", " a  b\t\nc ", "x y\x0bz\x0c", "é ü", "\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(word_count(df["t"])).collect()]
    assert got == [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in texts]


def test_empty_table_and_plan(spark, plan_of):
    df = spark.createDataFrame([], SCHEMA)
    assert choose_copies(df).count() == 0 and mix_documents(df).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert "Python" not in plan_of(choose_copies(docs)) and "Arrow" not in plan_of(mix_documents(docs))


def test_rows_alike_in_everything(spark):
    """Null ids, one text and one source in most rows: they are blocks like others, and the words fit."""
    alike = [(None, words(20, "w"), "a", str(k % 3)) for k in range(700)]
    other = [(k, words(20 + k % 5, "v"), "b", "") for k in range(300)]
    df = spark.createDataFrame([*alike, *other], SCHEMA)
    one = sorted(map(tuple, choose_copies(df).fillna(-1).collect()))
    assert one == sorted(map(tuple, choose_copies(df.repartition(7)).fillna(-1).collect()))
    want = targets({"a": 700 * 20, "b": sum(20 + k % 5 for k in range(300))})
    taken = Counter()
    for r in one:
        taken["a" if r[0] == -1 else "b"] += r[5]
    assert all(abs(taken[s] - want[s]) <= 24 for s in want), (taken, want)
    assert len({r[4] for r in one if r[0] == -1}) > 1  # not all or none of them
    mix = Counter(r["source"] for r in mix_documents(df).collect())
    assert mix["a"] == taken["a"] / 20


def test_numbers_of_rows_alike(spark, monkeypatch):
    from corpuscat.llm import mixing

    monkeypatch.setattr(mixing, "CHUNK_BITS", 3)
    df = spark.createDataFrame([(None, "x", 5)] * 21 + [(1, "x", 5)] * 8 + [(2, "y", 6)], "id bigint, source string, content bigint")
    got = Counter((r["id"], r["no"]) for r in mixing._numbered(df).collect())
    assert got == Counter([(None, k) for k in range(21)] + [(1, k) for k in range(8)] + [(2, 0)])


def test_mix_passes_on_columns_of_any_name(spark):
    names = "doc_id bigint, text string, source string, row int, copies int, hash int, each int, content string, id int"
    df = spark.createDataFrame([(i, words(9 + i, "w"), "a", 1, 2, 3, 4, "c", 5) for i in range(40)], names)
    mix = mix_documents(df)
    assert mix.columns == df.columns and {tuple(r)[3:] for r in mix.collect()} == {(1, 2, 3, 4, "c", 5)}


def test_very_long_text(spark):
    rows = [(0, "word " * 200_000, "a", "")] + [(k, words(50, "w"), "a", "") for k in range(1, 400)]
    got = choose_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["size"] for r in got} == {200_000, 50} and all(r["copies"] <= 2 for r in got)
