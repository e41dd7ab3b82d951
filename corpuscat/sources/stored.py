"""Tables that are computed once: cached results, label and vocabulary tables, run reports."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscat.session import drop_path


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def fingerprint(df: DataFrame) -> list[str]:
    """What the files that ``df`` reads look like: their number, and sums over path, length and time.

    Spark lists and sums the files; their contents are not read.
    """
    files = df.inputFiles()
    if not files:
        return ["0"]
    listed = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    marks = [F.sum(F.xxhash64("path", "length", "modificationTime", F.lit(salt)).cast("decimal(38,0)")) for salt in (0, 1)]
    return [str(v) for v in listed.agg(F.count(F.lit(1)), *marks).first()]


def stored_path(root: str, name: str, params: Mapping[str, object], inputs: Sequence[DataFrame] = ()) -> str:
    """A folder per parameter set and input, so that a changed rule or file never meets an old result."""
    known = {**params, "_inputs": [fingerprint(df) for df in inputs]} if inputs else params
    key = hashlib.sha256(json.dumps(known, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return f"{root.rstrip('/')}/{name}-{key}"


def materialise(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; built and written first unless a finished one is there.

    It is built beside ``path`` and renamed when it is whole, so a reader never sees part of
    it. Of several builders the first to rename wins, and the others read its table.
    """
    if not _exists(spark, f"{path}/_SUCCESS"):
        aside = f"{path}.building-{uuid.uuid4().hex}"
        build().write.parquet(aside)
        if not _renamed(spark, aside, path):
            drop_path(spark, aside)
    return spark.read.parquet(path)


def _renamed(spark: SparkSession, old: str, new: str) -> bool:
    """Rename a folder unless the new name is taken."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.getFileSystem(conf).makeQualified(old).toUri(), conf)
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(old, new, options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
            raise
        return False
    return True


def save_table(df: DataFrame, path: str) -> DataFrame:
    """Write a label index, vocabulary or count table and return it as stored."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int, mode: str = "errorifexists") -> DataFrame:
    """Write ``df`` as table ``name`` at ``path`` in ``buckets`` by ``key``, sorted within, and return the table.

    The rows are dealt by the key first, so that each bucket is written by one task.
    """
    dealt = df.repartition(buckets, F.col(key))
    dealt.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def save_report(metrics: DataFrame, config: Mapping[str, object], path: str) -> DataFrame:
    """One JSON record: the run's settings, and its test metrics as a nested object."""
    settings = [F.lit(v).alias(k) for k, v in config.items()]
    record = metrics.select(*settings, F.struct(*metrics.columns).alias("test_metrics"))
    record.coalesce(1).write.mode("overwrite").json(path)
    return metrics.sparkSession.read.schema(record.schema).json(path)
