"""Registration of queries and shared pieces of their oracle SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def clean(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({clean(x)}, ' '), lambda w: w <> '')"


def items(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, ','), lambda w: lower(trim(w))), lambda w: w <> '')"


CORPUS = """corpus AS (
  SELECT doc_id AS row_id, n_chars AS release_year, lang || ' ' || source AS title,
    nullif(source, 'src11') AS origin,
    CASE WHEN source = 'src7' THEN 'Unknown' ELSE nullif(source, 'src5') END AS director,
    CASE WHEN lang = 'fr' THEN ' ' ELSE nullif(source, 'src3') END AS "cast",
    CASE WHEN source = 'src13' THEN NULL WHEN lang = 'es' THEN 'unknown' ELSE lang || ', ' || source END AS genre,
    CASE WHEN source = 'src2' THEN NULL ELSE text END AS plot
  FROM documents)"""


def share(name: str, counts: str, n: str, pct: int) -> str:
    """CTE ``name(label, take)``: largest-remainder shares of ``n`` rows per class."""
    return f"""{name}_q AS (
  SELECT label, take, ({n} * take) // total AS base, ({n} * take) % total AS rem
  FROM {counts}, (SELECT sum({n})::BIGINT AS total, ((sum({n}) * {pct} + 99) // 100)::BIGINT AS take FROM {counts})),
{name} AS (
  SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= take - sum(base) OVER () THEN 1 ELSE 0 END AS take
  FROM {name}_q)"""


def split(base: str, plan: tuple[int, int, str], seed: int = 42) -> str:
    """CTE ``parts(row_id, label, split)`` over ``base(row_id, label)``."""
    first, second, of = plan
    left = "n - h.take" if of == "rest" else "h.take"
    test, val = ("h.take", "s.take") if of == "rest" else ("s.take", "h.take - s.take")
    return f"""sizes AS (SELECT label, count(*)::BIGINT AS n FROM {base} GROUP BY label),
{share('held', 'sizes', 'n', first)},
left_over AS (SELECT z.label, ({left})::BIGINT AS n FROM sizes z JOIN held h ON z.label = h.label),
{share('second', 'left_over', 'n', second)},
quota AS (SELECT h.label, {test} AS test, {val} AS val FROM held h JOIN second s ON h.label = s.label),
placed AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}:' || row_id), row_id) AS rk FROM {base}),
parts AS (
  SELECT row_id, p.label, CASE WHEN rk <= test THEN 'test' WHEN rk <= test + val THEN 'val' ELSE 'train' END AS split
  FROM placed p JOIN quota q ON p.label = q.label)"""
