"""One-sentence extractive summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscat.functions.text import sentences, words
from corpuscat.operators.scale import lookup, spread
from corpuscat.operators.tokens import token_counts
from corpuscat.session import cut_lineage


def extractive_summary(df: DataFrame, row_id: str, text: str, weights: DataFrame | None = None) -> DataFrame:
    """``(row_id, summary, score)``: the sentence with the highest mean word weight.

    ``weights`` is ``(token, n)``, by default the corpus frequencies. The earlier sentence
    wins a tie; a text without words has the summary '' and no score.
    """
    parts = spread(df.select(row_id, text)).select(row_id, F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))
    # Words are taken from the texts once and stored: they are counted, then looked up.
    parts = cut_lineage(parts.select(row_id, "pos", words(F.col("sentence")).alias("words")))
    each = parts.select(row_id, "pos", F.explode("words").alias("token"))
    complete = weights is None
    weights = cut_lineage(token_counts(parts, "words")) if weights is None else weights
    weighed = lookup(each, weights.select("token", "n", F.col("n").alias("w")), "token", "n", "left", complete=complete)
    mean = (F.sum(F.coalesce("w", F.lit(0))) / F.count(F.lit(1))).alias("score")
    scored = weighed.groupBy(row_id, "pos").agg(mean)
    best = scored.groupBy(row_id).agg(F.max(F.struct("score", (-F.col("pos")).alias("neg"))).alias("b"))
    picked = df.select(row_id, text).join(best, row_id, "left")
    sentence = F.get(sentences(F.col(text)), -F.col("b.neg"))
    return picked.select(row_id, F.coalesce(sentence, F.lit("")).alias("summary"), F.col("b.score").alias("score"))
