"""A corpus pipeline: language, exact and near copies, mixing, sub-word pieces.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept.
All but the last return the columns of ``documents``. Each stage takes an empty table, null
ids, texts and sources, rows that repeat and further columns of any name; what becomes of
them is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscat.llm import exact, language, mixing, near, pieces
from corpuscat.llm.queries import model_path
from corpuscat.session import drop_path, scratch_path, store
from corpuscat.sources.tables import table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; null texts, texts without a letter and those of no known language go.

    Repeated rows stay or go together.
    """
    return language.drop_rejected(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id, null ids last; of rows that repeat id and text one."""
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id.

    Rows without an id, null texts and texts without a word stay.
    """
    return near.drop_near(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: each document none, once or twice; a null source is one like others."""
    return mixing.mix_documents(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded text, one row per document of the mix; a null text is empty."""
    return pieces.encode_decode(docs, model_path())


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix", mix_stage),
    ("pieces", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored before the next stage reads it.

    A stored result goes when that of the next stage is whole; the last stage reads the mix.
    """
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = scratch_path(spark, name)
            docs = store(docs, path)
            if before:
                drop_path(spark, before)
            before = path
    return docs


# Trained models, signatures and tokenizers are beyond SQL: tests compare with brute force.
ORACLE_SQL = None
