"""Parquet tables, and documents in the shape of the movie-plot corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as a corpus with the reference columns, null marks and sentinels.

    Genres are comma lists of language and source; one language is ``unknown``, one source
    has none. Other sources and languages lack origin, director, cast or plot.
    """
    d = table(spark, folder, "documents")
    lang, source = F.col("lang"), F.col("source")
    return d.select(
        F.col("doc_id").alias("row_id"),
        F.col("n_chars").alias("release_year"),
        F.concat(lang, F.lit(" "), source).alias("title"),
        F.nullif(source, F.lit("src11")).alias("origin"),
        F.when(source == "src7", "Unknown").otherwise(F.nullif(source, F.lit("src5"))).alias("director"),
        F.when(lang == "fr", " ").otherwise(F.nullif(source, F.lit("src3"))).alias("cast"),
        F.when(source == "src13", None).when(lang == "es", "unknown").otherwise(F.concat(lang, F.lit(", "), source)).alias("genre"),
        F.when(source == "src2", None).otherwise(F.col("text")).alias("plot"),
    )
