"""Vocabulary, fixed-length encoding, token-length profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscat.functions.text import word_array
from corpuscat.operators.frequency import frequencies
from corpuscat.operators.scale import lookup, rank_all, spread
from corpuscat.session import cut_lineage

# Ids of the special tokens; vocabulary ids follow them.
PAD, UNK, CLS, SEP = 0, 1, 2, 3
FIRST_ID = 4


def token_counts(df: DataFrame, text: str) -> DataFrame:
    """``(token, n)`` over the normalised words of a text column."""
    each = spread(df.select(text)).select(F.explode(word_array(df, text)).alias("token"))
    return frequencies(each, "token").withColumnRenamed("value", "token")


def vocabulary(df: DataFrame, text: str, min_count: int = 1) -> DataFrame:
    """``(token, id, n)``: ids by falling count, ties by token."""
    return numbered(token_counts(df, text).filter(F.col("n") >= min_count))


def numbered(counts: DataFrame) -> DataFrame:
    """``counts(token, n)`` with ids by falling count, ties by token."""
    return rank_all(counts, [F.desc("n"), F.col("token")], "id", FIRST_ID).select("token", "id", "n")


def save_vocabulary(counts: DataFrame, path: str) -> None:
    """Store ``(token, id, n)``; a table without ids gets them first."""
    (counts if "id" in counts.columns else numbered(counts)).write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A stored vocabulary, read in full: its ids must be those from ``FIRST_ID`` on, each once."""
    vocab = spark.read.parquet(path)
    n, ids, tokens, low, high = vocab.agg(F.count(F.lit(1)), F.count_distinct("id"), F.count_distinct("token"), F.min("id"), F.max("id")).first()
    if n and (ids != n or tokens != n or low != FIRST_ID or high != FIRST_ID + n - 1):
        raise ValueError(f"the vocabulary at {path} does not number its {n} tokens from {FIRST_ID} on")
    return vocab


def padded(ids: Column, length: int) -> tuple[Column, Column]:
    """``input_ids`` and ``attention_mask`` for at most ``length - 2`` ids."""
    full = F.concat(F.array(F.lit(CLS)), ids, F.array(F.lit(SEP)))
    gap = F.lit(length) - F.size(full)
    input_ids = F.concat(full, F.array_repeat(F.lit(PAD), gap))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(full)), F.array_repeat(F.lit(0), gap))
    return input_ids, mask


def encode(df: DataFrame, row_id: str, text: str, vocab: DataFrame, length: int = 512) -> DataFrame:
    """``(row_id, input_ids, attention_mask)`` of fixed length, with CLS, SEP, UNK and PAD.

    The fixed length is the operator's meaning: the model input ends there. Words past it
    are dropped before they are looked up. A text without words still yields its row.
    """
    first = F.slice(word_array(df, text), 1, length - 2)
    stored = cut_lineage(spread(df.select(row_id, text)).select(row_id, first.alias("words")))
    each = stored.select(row_id, F.posexplode_outer("words").alias("pos", "token"))
    ids = lookup(each, vocab.select("token", "id", "n"), "token", "n", "left")
    # Place and id in one number: half of what a struct of them takes in a shuffle.
    one = F.when(F.col("token").isNotNull(), F.shiftleft(F.col("pos").cast("bigint"), 32) + F.coalesce(F.col("id").cast("bigint"), F.lit(UNK)))
    lists = ids.groupBy(row_id).agg(F.sort_array(F.collect_list(one)).alias("l"))
    found = F.transform("l", lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    input_ids, mask = padded(found, length)
    return lists.select(row_id, input_ids.alias("input_ids"), mask.alias("attention_mask"))


def length_profile(df: DataFrame, text: str, limit: int = 512) -> DataFrame:
    """Words per text: count, mean, quartiles, maximum, share that encoding would cut."""
    # Counted per distinct length first, so that the exact percentile gets a short table.
    n = F.size(word_array(df, text)).alias("t")
    lengths = spread(df.select(text)).select(n).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c")
    return (
        lengths.agg(
            total.alias("n"),
            (F.sum(F.col("t") * F.col("c")) / total).alias("mean_tokens"),
            F.percentile("t", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("c")).alias("q"),
            F.max("t").cast("bigint").alias("max_tokens"),
            (F.sum(F.when(F.col("t") > limit - 2, F.col("c")).otherwise(0)) / total).alias("cut_share"),
        )
        .select(
            "n",
            "mean_tokens",
            F.get("q", F.lit(0)).alias("p25"),
            F.get("q", F.lit(1)).alias("p50"),
            F.get("q", F.lit(2)).alias("p75"),
            "max_tokens",
            "cut_share",
        )
    )
