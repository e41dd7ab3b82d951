"""Exact copies against a dictionary of normalised texts."""

import hashlib
import re

from pyspark.sql import functions as F

from corpuscat.llm.exact import drop_copies, mark_copies

SCHEMA = "doc_id bigint, text string, kept string"


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def expected(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


ROWS = [
    (1, "a b", "x"), (2, "a  b", "y"), (3, "a\t\n b", None), (4, " a b", "z"), (5, None, "n"), (6, "", "n"), (7, "  ", "n"), (8, "\n", "n"),
    (9, "c" * 200_000, "long"), (10, "c" * 200_000 + " ", "long"), (11, "c" * 200_000, "long"), (None, "c d", "null id"), (12, "c d", "q"),
    (13, "dup", "r"), (13, "dup", "r"), (14, "dup", "r"), (None, "only null", "s"), (None, "only null", "t"),
    *((100 + k, "hot text " + " " * (k % 3), "hot") for k in range(300)),
]


def test_groups_and_heavy_texts(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(7)
    got = mark_copies(df).collect()
    want = expected(ROWS)
    assert len(got) == len(ROWS)
    for r in got:
        keep, size = want[norm(r["text"])]
        assert (r["keep_id"], r["group_size"]) == (keep, size)
        assert r["text_sha256"] == hashlib.sha256(norm(r["text"]).encode()).hexdigest()
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(want) and len({norm(r["text"]) for r in kept}) == len(want)
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_columns_of_the_documents_stay(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = drop_copies(df)
    assert out.columns == df.columns and out.count() == len(expected(ROWS))
    assert {r["kept"] for r in out.filter("doc_id in (1, 4)").collect()} == {"x", "z"}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mark_copies(df).count() == 0 and drop_copies(df).count() == 0


def test_plan_is_native_with_one_exchange_of_texts(spark, plan_of):
    plan = plan_of(mark_copies(spark.createDataFrame(ROWS, SCHEMA)))
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan


def test_order_of_the_rows_does_not_matter(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    one = sorted(map(tuple, mark_copies(df).select("doc_id", "keep_id", "group_size", "kept").fillna(-1).collect()))
    two = sorted(map(tuple, mark_copies(df.orderBy(F.desc("doc_id"))).select("doc_id", "keep_id", "group_size", "kept").fillna(-1).collect()))
    assert one == two
