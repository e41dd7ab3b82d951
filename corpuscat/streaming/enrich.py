"""Enrichment of files as they arrive, each row once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corpuscat.operators.enrich import enrich_missing


def enrich_new_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    row_id: str,
    store: str,
    progress: str,
    enrich: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Enrich the parquet files under ``source`` not seen before, and return the whole store.

    ``progress`` remembers the files. A batch that is replayed after a failure meets its
    own rows in the store and skips them.
    """

    def one_batch(batch: DataFrame, _: int) -> None:
        enrich_missing(batch, row_id, store, enrich)

    files = spark.readStream.schema(schema).parquet(source)
    run = files.writeStream.foreachBatch(one_batch).option("checkpointLocation", progress)
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(store)
