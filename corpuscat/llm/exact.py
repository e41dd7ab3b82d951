"""Exact copies by content sort, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscat.session import cut_lineage

# A run of white space that is not one space already.
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
HEAD = 64  # characters of a text that splitters are made of
ADDED = ["keep_id", "group_size", "kept", "text_sha256"]


def one_space(text: Column) -> Column:
    """``text`` with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``keep_id, group_size, kept, text_sha256`` for each row, dropped ones too.

    Texts are equal when their normalised forms are. Splitters sampled from the heads of
    those forms, with a digest for texts of one head, range-partition the rows. Each
    partition is sorted, on disk if need be, and a window compares each text in full with
    its neighbour; the smallest id of a run stays. Only heads and digests reach the driver.

    A text with more copies than an even share of a partition would fill one task. Such
    texts, fewer than there are partitions, are found by a count per digest that combines
    before its shuffle. They are dealt over several runs by id, and take the smallest id
    and the size from that count.

    Null texts are empty ones. Null ids sort last. Of rows that repeat id and text exactly
    one is kept. An empty table gives an empty result. Columns of ``docs`` named like an
    added one are replaced; others pass through.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = docs.count() // parts + 1
    # Named apart from whatever columns the documents have.
    rows = docs.drop(*ADDED).withColumn("_xd_norm", one_space(F.col(f"`{text_col}`")))
    rows = rows.withColumn("_xd_sha", F.sha2(F.col("_xd_norm"), 256))
    heavy = cut_lineage(
        rows.groupBy("_xd_sha")
        .agg(F.min(f"`{id_col}`").alias("_xd_min"), F.count(F.lit(1)).alias("_xd_n"))
        .filter(F.col("_xd_n") > share)
    )
    key = F.col(f"`{id_col}`")
    salts = F.ceil(F.coalesce(F.col("_xd_n"), F.lit(1)) / share)
    # Heavy texts are fewer than partitions, each of 80 bytes here.
    dealt = rows.join(F.broadcast(heavy), "_xd_sha", "left").withColumn("_xd_salt", F.pmod(F.xxhash64(key), salts).cast("int"))
    dealt = dealt.withColumn("_xd_head", F.substring("_xd_norm", 1, HEAD))
    ordered = dealt.repartitionByRange("_xd_head", "_xd_sha", "_xd_salt")
    run = Window.partitionBy("_xd_head", "_xd_sha", "_xd_salt", "_xd_norm").orderBy(key.asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = ordered.withColumns(
        {
            "_xd_first": F.first(key).over(whole),
            "_xd_size": F.count(F.lit(1)).over(whole),
            "_xd_rank": F.row_number().over(run),
        }
    )
    keep = F.when(F.col("_xd_n").isNull(), F.col("_xd_first")).otherwise(F.col("_xd_min"))
    return found.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ADDED],
        keep.alias("keep_id"),
        F.coalesce(F.col("_xd_n"), F.col("_xd_size")).alias("group_size"),
        ((F.col("_xd_rank") == 1) & key.eqNullSafe(keep)).alias("kept"),
        F.col("_xd_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``mark_copies`` keeps, with their own columns.

    Of equal texts the row with the smallest id stays, of rows that repeat id and text one;
    null texts are empty ones, null ids sort last. An empty table gives an empty result.
    Columns named like those of ``mark_copies`` keep their own values.
    """
    slim = docs.drop(*ADDED)
    if slim.columns == docs.columns:
        return mark_copies(docs, id_col, text_col).filter("kept").select(*[F.col(f"`{c}`") for c in docs.columns])
    # Columns named like the added ones travel under other names.
    away = {c: f"_own_{c}" for c in docs.columns if c in ADDED}
    kept = mark_copies(docs.withColumnsRenamed(away), id_col, text_col).filter("kept").drop(*ADDED)
    return kept.withColumnsRenamed({v: k for k, v in away.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])
