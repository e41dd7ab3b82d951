"""Row filters, defaults for missing values, keep-first deduplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscat.operators.scale import BROADCAST_BYTES, row_bytes
from corpuscat.session import cut_lineage


def exclude_value(df: DataFrame, col: str, value: str) -> DataFrame:
    """Rows whose value is not ``value``; rows with null stay."""
    return df.filter(~F.col(f"`{col}`").eqNullSafe(F.lit(value)))


def keep_present(df: DataFrame, col: str, blank: str = " ") -> DataFrame:
    """Rows with a value that is neither null nor the blank mark."""
    c = F.col(f"`{col}`")
    return df.filter(c.isNotNull() & (c != blank))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def fill_defaults(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    return df.fillna(dict(defaults))


def keep_first(df: DataFrame, keys: Sequence[str], row_id: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per key, the one with the lowest ``row_id``; nulls count as equal. Row ids are unique.

    Rows are neither sorted nor moved: only their ids and keys are, strings as SHA-256
    digests, and each task keeps its first id per key before the shuffle. The ids that are
    not first leave ``df`` by a broadcast join if they measure at most ``max_bytes``; else the
    rows meet the first ids in a join by id, which no key makes heavy.
    """
    types = dict(df.dtypes)
    by = [(F.sha2(F.col(f"`{k}`"), 256) if types[k] == "string" else F.col(f"`{k}`")).alias(f"k{i}") for i, k in enumerate(keys)]
    slim = cut_lineage(df.select(F.col(f"`{row_id}`").alias("id"), *by))
    first = cut_lineage(slim.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.min("id").alias("id")).select("id"))
    others = cut_lineage(slim.select("id").join(first, "id", "left_anti"))
    size = others.agg(F.sum(row_bytes(others))).first()[0] or 0
    if size <= max_bytes:
        return df.join(F.broadcast(others.withColumnRenamed("id", row_id)), row_id, "left_anti").select(*[f"`{c}`" for c in df.columns])
    return df.join(first.withColumnRenamed("id", row_id), row_id, "left_semi").select(*[f"`{c}`" for c in df.columns])
