"""Stratified splits with exact sizes.

Inside a class, rows are ordered by a seeded hash of their id; the first ones go to the
first part, the next ones to the second, the rest to ``train``. A split is fixed by one
threshold per class and part, so the rows themselves are never shuffled or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscat.operators.scale import LITERAL_ROWS, bounded_rows, lookup, rank_all
from corpuscat.session import cut_lineage

# The two published splits. First share held out, second share, and what
# the second is a share of: the rest (test 20, then val 20 of 80) or the held part
# (20 held, then half of it for test).
SPLIT_64_16_20 = (20, 20, "rest")
SPLIT_80_10_10 = (20, 50, "held")
PARTS = ("test", "val", "train")

_HEX = 4  # hash digits of the per-class histogram: 65,536 buckets


def _check(pct: int, classes: int, total: int, least: int, smallest: object) -> int:
    """Rows to take, as ceil of the share; stratification needs two rows per class."""
    if least < 2:
        raise ValueError(f"class {smallest!r} has fewer than 2 rows to split at {pct}%")
    take = -(-total * pct // 100)
    if min(take, total - take) < classes:
        raise ValueError(f"{total} rows are too few to split {classes} classes at {pct}%")
    return take


def listed_shares(counts: dict, pct: int) -> dict:
    """Rows to take per class by largest remainder, ties to the smaller label."""
    if not counts:
        return {}
    total = sum(counts.values())
    smallest = min(counts, key=counts.get)
    take = _check(pct, len(counts), total, counts[smallest], smallest)
    short = take - sum(n * take // total for n in counts.values())
    by_rem = sorted(counts, key=lambda c: (-(counts[c] * take % total), c))
    return {c: counts[c] * take // total + (rank < short) for rank, c in enumerate(by_rem)}


def ranked_shares(counts: DataFrame, label: str, n: str, pct: int, out: str) -> DataFrame:
    """``listed_shares`` for more classes than a literal holds: adds column ``out``."""
    size = F.col(n)
    classes, total, least, smallest = counts.agg(
        F.count(F.lit(1)), F.sum(size), F.min(size), F.min_by(F.col(label).cast("string"), size)
    ).first()
    take = _check(pct, classes, total, least, smallest)
    # decimal(38): rows times rows overflows a bigint at scale
    product = size.cast("decimal(19,0)") * F.lit(take).cast("decimal(19,0)")
    whole = F.lit(total).cast("decimal(19,0)")
    counts = counts.withColumn("_rem", (product % whole).cast("bigint"))
    counts = counts.withColumn("_base", ((product - F.col("_rem").cast("decimal(19,0)")) / whole).cast("bigint"))
    short = take - counts.agg(F.sum("_base")).first()[0]
    ranked = rank_all(counts, [F.desc("_rem"), F.col(label)], "_rank")
    return ranked.withColumn(out, F.col("_base") + (F.col("_rank") < short).cast("bigint")).drop("_rem", "_base", "_rank")


def listed_sizes(size: dict, plan: tuple[int, int, str]) -> list[tuple]:
    """``(label, n, test, val)`` for a listed set of classes."""
    first, second, of = plan
    held = listed_shares(size, first)
    if of == "rest":
        test, val = held, listed_shares({c: size[c] - held[c] for c in size}, second)
    else:
        test = listed_shares(held, second)
        val = {c: held[c] - test[c] for c in size}
    return [(c, size[c], test[c], val[c]) for c in sorted(size)]


def ranked_sizes(counts: DataFrame, label: str, plan: tuple[int, int, str]) -> DataFrame:
    """``listed_sizes`` for more classes than a literal holds."""
    first, second, of = plan
    out = ranked_shares(counts, label, "n", first, "held")
    if of == "rest":
        out = ranked_shares(out.withColumn("left", F.col("n") - F.col("held")), label, "left", second, "val")
        return out.select(label, "n", F.col("held").alias("test"), "val")
    out = ranked_shares(out, label, "held", second, "test")
    return out.select(label, "n", "test", (F.col("held") - F.col("test")).alias("val"))


def _key(row_id: str, seed: int) -> tuple[Column, Column]:
    """The order of the rows inside a class, and the bucket of the histogram that a row is in."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))
    return F.struct(hashed.alias("h"), F.col(row_id).alias("id")), F.conv(F.substring(hashed, 1, _HEX), 16, 10).cast("int")


def _histogram(df: DataFrame, label: str, bucket: Column) -> DataFrame:
    return cut_lineage(df.select(label, bucket.alias("b")).groupBy(label, "b").agg(F.count(F.lit(1)).alias("c")))


def _limits(df: DataFrame, label: str, key: Column, bucket: Column, hist: DataFrame, sizes: DataFrame, listed: bool) -> DataFrame:
    """``(label, n, _test, _val)``: the key of the last row of each part, null for a part without rows."""
    spark = df.sparkSession

    def settled(table: DataFrame) -> DataFrame:
        """One row per class: a literal table for a listed set of classes, else stored."""
        return spark.createDataFrame(table.collect(), table.schema) if listed else cut_lineage(table)

    # The last rank of each part inside its class, and the bucket in which it falls.
    last = [("test", F.col("test")), ("val", F.col("test") + F.col("val"))]
    marks = sizes.select(label, "n", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), r.alias("upto")) for p, r in last])))
    upper = F.sum("c").over(Window.partitionBy(label).orderBy("b"))
    edge = F.struct("part", "b", (F.col("upto") - F.col("hi") + F.col("c")).alias("need"))
    edges = settled(
        hist.withColumn("hi", upper)
        .join(marks, label)
        .filter("upto > hi - c and upto <= hi")
        .groupBy(label)
        .agg(F.any_value("n").alias("n"), F.collect_list(edge).alias("edges"))
    )

    # Only the rows of these buckets are ranked, a 65,536th part of a class each.
    near = lookup(df.select(label, bucket.alias("b"), key.alias("k")), edges, label, "n", bounded=listed)
    near = near.filter(F.exists("edges", lambda e: e["b"] == F.col("b")))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy(label, "b").orderBy("k")))
    near = near.select(label, "k", "b", "r", F.explode("edges").alias("e")).filter("b = e.b and r = e.need")
    limits = [F.max(F.when(F.col("e.part") == p, F.col("k"))).alias(f"_{p}") for p, _ in last]
    return settled(sizes.select(label, "n").join(near.groupBy(label).agg(*limits), label, "left"))


def _parted(df: DataFrame, limit: DataFrame, label: str, key: Column, out: str, listed: bool) -> DataFrame:
    part = F.lit("train")
    for p in ("val", "test"):
        part = F.when(key <= F.col(f"_{p}"), p).otherwise(part)
    return lookup(df, limit, label, "n", bounded=listed).withColumn(out, part).select(*df.columns, out)


def stratified_split(
    df: DataFrame,
    label: str,
    row_id: str,
    plan: tuple[int, int, str],
    seed: int = 42,
    out: str = "split",
    class_limit: int = LITERAL_ROWS,
) -> DataFrame:
    """Add the part (test, val or train) of each row."""
    spark = df.sparkSession
    key, bucket = _key(row_id, seed)
    hist = _histogram(df, label, bucket)
    counts = hist.groupBy(label).agg(F.sum("c").alias("n"))
    few = bounded_rows(counts, class_limit)
    if few is not None:
        listed = {r[label]: r["n"] for r in few}
        if None in listed:
            raise ValueError("a row has no label")
        kind = df.schema[label].dataType.simpleString()
        sizes = spark.createDataFrame(listed_sizes(listed, plan), f"`{label}` {kind}, n bigint, test bigint, val bigint")
    else:
        if hist.filter(F.col(label).isNull()).limit(1).count():
            raise ValueError("a row has no label")
        sizes = ranked_sizes(counts, label, plan)
    limit = _limits(df, label, key, bucket, hist, sizes, few is not None)
    return _parted(df, limit, label, key, out, few is not None)


def part_counts(parts: DataFrame, label: str, split: str = "split") -> DataFrame:
    """``(label, n, test, val)`` of rows that are split: all that a later batch needs to know of them."""
    return parts.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(split) == "test").alias("test"), F.count_if(F.col(split) == "val").alias("val")
    )


def split_later(
    rows: DataFrame,
    counts: DataFrame,
    label: str,
    row_id: str,
    plan: tuple[int, int, str],
    seed: int = 42,
    out: str = "split",
    class_limit: int = LITERAL_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Split rows that arrive after others; returns them with their part, and the new ``counts``.

    ``counts`` are the ``part_counts`` of everything split before, one row per class: earlier
    rows are neither read nor moved. Each class gets what its old and new rows together should
    have in a part, rounded, less what it has, so that test and val of every class follow their
    shares of all rows so far, as near as whole rows and earlier parts allow. Inside the batch,
    rows go by the hash of their id. A class that is new begins at nothing, of any size; a row
    without a label is an error. ``counts`` may be stored with the batch; of an empty batch
    it comes back as it was.
    """
    first, second, of = plan
    # Shares in ten-thousandths.
    test_share = first * 100 if of == "rest" else first * second
    val_share = (100 - first) * second if of == "rest" else first * (100 - second)
    key, bucket = _key(row_id, seed)
    hist = _histogram(rows, label, bucket)
    if hist.filter(F.col(label).isNull()).limit(1).count():
        raise ValueError("a row has no label")
    had = counts.select(label, *[F.col(c).cast("decimal(19,0)").alias(f"_had_{c}") for c in ("n", "test", "val")])
    batch = hist.groupBy(label).agg(F.sum("c").alias("n")).join(had, label, "full").na.fill(0)

    def due(share: int, part: str) -> Column:
        """What is wanted of all rows, half a row and more counting as one, less what is there."""
        whole = ((F.col("_had_n") + F.col("n")) * share + 5_000).cast("decimal(38,0)")
        return F.floor(whole / 10_000).cast("bigint") - F.col(f"_had_{part}").cast("bigint")

    none = F.lit(0).cast("bigint")
    batch = batch.withColumn("test", F.least("n", F.greatest(none, due(test_share, "test"))))
    batch = cut_lineage(batch.withColumn("val", F.least(F.col("n") - F.col("test"), F.greatest(none, due(val_share, "val")))))
    total = batch.select(label, *[(F.col(c) + F.col(f"_had_{c}").cast("bigint")).alias(c) for c in ("n", "test", "val")])
    sizes = batch.filter("n > 0").select(label, "n", "test", "val")
    listed = bounded_rows(sizes, class_limit) is not None
    limit = _limits(rows, label, key, bucket, hist, sizes, listed)
    return _parted(rows, limit, label, key, out, listed), total


def split_64_16_20(df: DataFrame, label: str, row_id: str, seed: int = 42) -> DataFrame:
    return stratified_split(df, label, row_id, SPLIT_64_16_20, seed)


def split_80_10_10(df: DataFrame, label: str, row_id: str, seed: int = 42) -> DataFrame:
    return stratified_split(df, label, row_id, SPLIT_80_10_10, seed)


def split_sizes(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
