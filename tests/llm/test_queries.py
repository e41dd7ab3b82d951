"""Registered queries: oracle SQL where there is some, whole tables everywhere."""

import pytest
from conftest import SF

from check_oracles import compare, connect
from corpuscat.llm.queries import ORACLES, QUERIES

ROWS = {"op2_main_text": "pages", "op5_vector_links": "embeddings"}


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    ok, note = compare(spark, connect(SF), name, SF)
    assert ok, note


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_one_row_each(spark, name):
    table = spark.read.parquet(f"{SF}/{ROWS.get(name, 'documents')}.parquet")
    got = QUERIES[name](spark, SF)
    key = table.columns[0]
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in table.select(key).collect())


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
