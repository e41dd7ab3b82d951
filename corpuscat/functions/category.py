"""Category expressions over a short list of top categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def canonical_category(category: Column, top: Sequence[str]) -> Column:
    """A top category stays; another becomes the first top category it contains, if any."""
    held = F.filter(_strings(top), lambda t: F.contains(category, t))
    return F.when(category.isin(*top), category).otherwise(F.coalesce(F.get(held, F.lit(0)), category))


def collapse_category(category: Column, top: Sequence[str], other: str = "other") -> Column:
    """A top category stays; every other one, null included, becomes ``other``."""
    return F.when(category.isin(*top), category).otherwise(F.lit(other))


def multi_hot(categories: Column, classes: Sequence[str]) -> Column:
    """0/1 per class, in the given order."""
    return F.transform(_strings(classes), lambda c: F.array_contains(categories, c).cast("int"))
