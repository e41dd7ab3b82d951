"""Multinomial naive Bayes on word counts, as count tables and joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscat.functions.text import word_array
from corpuscat.operators.scale import lookup, spread
from corpuscat.session import cut_lineage

LOG_UNIT = 1e11  # logarithms are summed as whole multiples of 1 / LOG_UNIT
BLOCK = 16  # labels whose numbers travel side by side
CHUNK = 1_024  # kinds of classes summed in one row


@dataclass(frozen=True)
class BayesModel:
    """``terms``: (token, n, blocks array of (block, counts)), where ``counts`` are those of the labels
    from ``block * BLOCK`` on, up to the highest one in a model of fewer labels. ``classes``: (label, docs, tokens, vocab)."""

    terms: DataFrame
    classes: DataFrame

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.classes.write.mode("overwrite").parquet(f"{path}/classes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BayesModel:
        return BayesModel(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/classes"))


def _block(label: str | Column) -> Column:
    return F.floor(F.col(label) / BLOCK) if isinstance(label, str) else F.floor(label / BLOCK)


def fit_bayes(df: DataFrame, text: str, label: str) -> BayesModel:
    """Count words per class. Labels are non-negative integers."""
    y = F.col(label).cast("bigint").alias("label")
    docs = cut_lineage(df.groupBy(y).agg(F.count(F.lit(1)).alias("docs")))
    width, one = _width(docs)
    each = spread(df.select(label, text)).select(y, F.explode(word_array(df, text)).alias("token"))
    counts = [F.count_if(F.col("label") % BLOCK == i) for i in range(width)]
    sums = [F.array(*counts).alias("counts"), F.count(F.lit(1)).alias("n")]
    if one:
        words = each.groupBy("token").agg(*sums)
        terms = words.select("token", "n", F.array(F.struct(F.lit(0).cast("bigint").alias("block"), "counts")).alias("blocks"))
    else:
        words = each.groupBy("token", _block("label").alias("block")).agg(*sums)
        terms = words.groupBy("token").agg(F.sum("n").alias("n"), F.collect_list(F.struct("block", "counts")).alias("blocks"))
    terms = cut_lineage(terms)
    per_block = terms.select(F.inline("blocks")).groupBy("block").agg(*[F.sum(F.get("counts", F.lit(i))).alias(f"t{i}") for i in range(width)])
    tokens = per_block.select("block", F.posexplode(F.array(*[f"t{i}" for i in range(width)])).alias("i", "tokens"))
    tokens = tokens.select((F.col("block") * BLOCK + F.col("i")).alias("label"), "tokens")
    vocab = terms.count()
    classes = docs.join(tokens, "label", "left").fillna(0, ["tokens"]).withColumn("vocab", F.lit(vocab).cast("bigint"))
    return BayesModel(terms, cut_lineage(classes))


def _width(classes: DataFrame) -> tuple[int, bool]:
    """How many numbers of a block the labels of ``classes`` take, and whether all labels are in the first block."""
    low, high, without = classes.agg(F.min("label"), F.max("label"), F.count_if(F.col("label").isNull())).first()
    if high is None:
        return BLOCK, False
    return max(1, min(BLOCK, high + 1)), not without and low >= 0 and high < BLOCK


def _line(a: float, total: int, vocab: int) -> tuple[Column, Column]:
    """What a class of ``docs`` and ``tokens`` scores without hits: a start and a step per seen word."""
    start = F.log(F.col("docs").cast("double") / F.lit(float(total)))
    return start, F.log(F.lit(float(a)) / (F.col("tokens").cast("double") + F.lit(float(a) * vocab)))


def upper_lines(start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``at, low, high``: the lines ``start + x * step`` that are highest for some x >= 0, and from where to where."""
    order = np.lexsort((-start, -step))  # steepest last; of parallel lines the highest first
    # Seen from x = 0 on, lines of ever greater step take over.
    hull: list[int] = []
    low: list[float] = []
    for i in order[::-1].tolist():
        if hull and step[i] == step[hull[-1]]:
            if start[i] <= start[hull[-1]]:
                continue
            hull.pop()
            low.pop()
        begin = 0.0
        while hull:
            begin = (start[hull[-1]] - start[i]) / (step[i] - step[hull[-1]])
            if begin > low[-1]:
                break
            hull.pop()
            low.pop()
            begin = 0.0
        hull.append(i)
        low.append(max(begin, 0.0))
    return np.array(hull, int), np.array(low), np.array([*low[1:], np.inf])


def _hulls(candidates: int):
    """Of the lines of a partition those that no others cover, for each candidate."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(candidates):
                part = pa.Table.from_batches([batch]).filter(pc.equal(batch.column(0), i))
                # Lines of earlier batches that are covered now go again.
                held = held or {}
                held[i] = _highest(part if i not in held else pa.concat_tables([held[i].select(part.column_names), part]))
        for table in (held or {}).values():
            yield from table.combine_chunks().to_batches()

    return cut


def _highest(lines: pa.Table) -> pa.Table:
    at, low, high = upper_lines(lines["start"].to_numpy(), lines["step"].to_numpy())
    kept = lines.select(["candidate", "label", "start", "step"]).take(pa.array(at))
    return kept.append_column("low", pa.array(low, pa.float64())).append_column("high", pa.array(high, pa.float64()))


def _kinds(classes: DataFrame, alphas: Sequence[float], total: int, vocab: int) -> DataFrame:
    """Classes of one (docs, tokens) as one: their number ``k``, lowest ``label``, and lines ``a0, b0, ..``."""
    same = classes.groupBy("docs", "tokens").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("k"))
    return cut_lineage(same.select("label", "k", *[c.alias(f"{k}{i}") for i, a in enumerate(alphas) for k, c in zip("ab", _line(a, total, vocab))]))


def _without_hits(kinds: DataFrame, lengths: DataFrame, candidates: int, loss: bool) -> DataFrame:
    """``lengths(seen, texts)`` with ``base``: per candidate the best class without hits, and all such classes' sum.

    A class without hits scores ``start + seen * step``, so the best one for each number of
    seen words lies on the upper envelope of the lines of all classes: few lines, found task
    by task and then among those that the tasks leave. Only the sum under a softmax has to
    meet every kind of class; it does so in rows of ``CHUNK`` kinds.
    """
    each = F.array(*[F.struct(F.lit(i).alias("candidate"), "label", F.col(f"a{i}").alias("start"), F.col(f"b{i}").alias("step")) for i in range(candidates)])
    lines = kinds.select(F.inline(each))
    schema = "candidate int, label bigint, start double, step double, low double, high double"
    local = lines.mapInArrow(_hulls(candidates), schema).select("candidate", "label", "start", "step")
    top = local.coalesce(1).mapInArrow(_hulls(candidates), schema)
    # An interval without a whole number in it (and one beside, for rounding) is of no length.
    top = top.filter((F.ceil(F.col("low") - 1) <= F.col("high") + 1)).groupBy().agg(F.collect_list(F.struct("candidate", "low", "high", "label", "start", "step")).alias("hull"))
    seen = F.col("seen")
    found = lengths.withColumn("_one", F.lit(1)).join(F.broadcast(cut_lineage(top.withColumn("_one", F.lit(1)))), "_one").drop("_one")

    def best(i: int) -> Column:
        here = F.filter("hull", lambda h: (h["candidate"] == i) & (h["low"] - 1 <= seen) & (seen <= h["high"] + 1))
        return F.array_max(F.transform(here, lambda h: F.struct((h["start"] + seen * h["step"]).alias("score"), (-h["label"]).alias("neg"))))

    found = found.select("seen", "texts", *[best(i).alias(f"t{i}") for i in range(candidates)])
    if not loss:
        packed = [F.struct(F.col(f"t{i}.score").alias("peak"), (-F.col(f"t{i}.neg")).alias("label"), F.lit(None).cast("double").alias("total")) for i in range(candidates)]
        return found.select("seen", "texts", F.array(*packed).alias("base"))

    chunks = -(-kinds.count() // CHUNK)
    lines_of = [f"{k}{i}" for i in range(candidates) for k in "ab"]
    packs = kinds.groupBy(F.pmod(F.xxhash64("label"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("k", *lines_of)).alias("lines"))
    met = found.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(packs, "chunk")

    def mass(i: int) -> Column:
        return F.aggregate("lines", F.lit(0.0), lambda acc, p: acc + p["k"] * F.exp(p[f"a{i}"] + seen * p[f"b{i}"] - F.col(f"t{i}.score")))

    tops = [F.first(f"t{i}").alias(f"t{i}") for i in range(candidates)]
    sums = met.select("seen", "texts", *[f"t{i}" for i in range(candidates)], *[mass(i).alias(f"z{i}") for i in range(candidates)])
    sums = sums.groupBy("seen", "texts").agg(*tops, *[F.sum(f"z{i}").alias(f"z{i}") for i in range(candidates)])
    packed = [F.struct(F.col(f"t{i}.score").alias("peak"), (-F.col(f"t{i}.neg")).alias("label"), F.col(f"z{i}").alias("total")) for i in range(candidates)]
    return sums.select("seen", "texts", F.array(*packed).alias("base"))


def bayes_predict(
    df: DataFrame, row_id: str, text: str, label: str, model: BayesModel, alphas: Sequence[float] = (1.0,), loss: bool = True
) -> DataFrame:
    """``(row_id, candidate, alpha, label, prediction, score, loss)``, one row per smoothing candidate.

    Words outside the model's vocabulary do not count. A word adds ``ln((n + a) / a)`` to
    the classes that have it and each seen word ``ln(a / (tokens + a V))`` to every class.
    Words are joined where they are to the blocks of ``BLOCK`` labels that have them, whose
    numbers are summed side by side before the shuffle; only rare words are moved. A text only
    meets blocks it has words of; all other classes score by its number of words alone (``_without_hits``). Any
    number of classes will do.

    Logarithms are summed as whole multiples of 1 / ``LOG_UNIT``, so sums do not depend on
    their order and scores are compared as they are; on a tie the lowest label wins.
    ``loss`` is ``-ln p(label)`` under the softmax of all scores; it is null for a label
    that the model does not have, and everywhere if the caller does not ask for it.
    """
    many = len(alphas)
    stats = model.classes.agg(F.sum("docs"), F.max("vocab")).first()
    total, vocab = stats[0] or 0, stats[1] or 0
    width, _ = _width(model.classes)
    y = F.col(label).cast("bigint").alias("label")
    rows = spread(df.select(row_id, label, text)).select(row_id, y, word_array(df, text).alias("_words"))
    if df.schema[text].dataType.typeName() != "array":
        rows = cut_lineage(rows)
    each = rows.select(row_id, "label", F.explode("_words").alias("token"))

    def gains_of(counts: Column, a: float) -> Column:
        gain = lambda n: F.round(F.log((n + F.lit(float(a))) / F.lit(float(a))) * LOG_UNIT).cast("bigint")
        return F.transform(counts, lambda n: F.when(n == 0, F.lit(0).cast("bigint")).otherwise(gain(n)))  # most counts are 0

    # A model of few labels has only their numbers in its block.
    gains = F.transform(
        "blocks", lambda b: F.struct(b["block"].alias("block"), F.concat(*[gains_of(F.slice(b["counts"], 1, width), a) for a in alphas]).alias("g"))
    )
    terms = cut_lineage(model.terms.select("token", "n", gains.alias("gains")))
    hits = lookup(each, terms, "token", "n").select(row_id, "label", F.posexplode("gains").alias("p", "b"))
    # A word counts as seen with its first block.
    hits = hits.select(row_id, "label", F.col("b.block").alias("block"), F.when(F.col("p") == 0, 1).otherwise(0).cast("bigint").alias("words"), F.col("b.g").alias("g"))
    # The block of the text's own label is there for every text, if only with zeros.
    none = F.array_repeat(F.lit(0).cast("bigint"), many * width)
    own = rows.select(row_id, "label", _block("label").alias("block"), F.lit(0).cast("bigint").alias("words"), none.alias("g"))
    sums = [F.sum(F.get("g", F.lit(j))) for j in range(many * width)]
    per_block = hits.unionByName(own).groupBy(row_id, "label", "block").agg(F.sum("words").alias("words"), F.array(*sums).alias("s"))
    lines = F.struct("label", *[c.alias(f"{k}{i}") for i, a in enumerate(alphas) for k, c in zip("ab", _line(a, total, vocab))])
    blocks = model.classes.groupBy(_block("label").alias("block")).agg(F.sum("docs").alias("docs"), F.collect_list(lines).alias("lines"))
    fits = lookup(per_block, cut_lineage(blocks), "block", "docs", "left")
    docs = cut_lineage(fits.groupBy(row_id, "label").agg(F.sum("words").alias("seen"), F.collect_list(F.struct("block", "s", "lines")).alias("hits")))
    lengths = docs.groupBy("seen").agg(F.count(F.lit(1)).alias("texts"))
    base = cut_lineage(_without_hits(_kinds(model.classes, alphas, total, vocab), lengths, many, loss))
    settled = lookup(docs, base, "seen", "texts", complete=True)
    # Each step is a column of its own: what a later step uses for each class is computed once for the text.
    scored = settled.select(row_id, "label", "base", *[_scores(i, width).alias(f"c{i}") for i in range(many)])
    topped = scored.select("*", *[_top(i).alias(f"t{i}") for i in range(many)])
    return topped.select(row_id, "label", F.inline(F.array(*[_settle(i, a, loss) for i, a in enumerate(alphas)])))


def _scores(i: int, width: int) -> Column:
    """Score, label and score without hits of all classes in the blocks that a text meets."""
    seen = F.col("seen")

    def of_block(h: Column) -> Column:
        def one(c: Column) -> Column:
            floor = c[f"a{i}"] + seen * c[f"b{i}"]
            gained = F.get(h["s"], F.lit(i * width) + (c["label"] % BLOCK).cast("int"))
            return F.struct((floor + gained / F.lit(LOG_UNIT)).alias("score"), (-c["label"]).alias("neg"), floor.alias("floor"))

        return F.transform(h["lines"], one)

    return F.flatten(F.transform(F.filter("hits", lambda h: h["lines"].isNotNull()), of_block))


def _top(i: int) -> Column:
    # A class with hits scores more than without, so the best without hits may stand for all others.
    base = F.get("base", F.lit(i))
    met = F.transform(f"c{i}", lambda p: F.struct(p["score"].alias("score"), p["neg"].alias("neg")))
    return F.array_max(F.concat(met, F.array(F.struct(base["peak"].alias("score"), (-base["label"]).alias("neg")))))


def _settle(i: int, a: float, loss: bool) -> Column:
    """Prediction, score and loss of one candidate."""
    peak, base, value = F.col(f"t{i}.score"), F.get("base", F.lit(i)), F.lit(None).cast("double")
    if loss:
        # The peak travels in the sum, so that it is looked up once and not for each class.
        start = F.struct(peak.alias("peak"), F.lit(0.0).alias("met"), F.lit(0.0).alias("floors"))

        def add(acc: Column, p: Column) -> Column:
            return F.struct(acc["peak"].alias("peak"), (acc["met"] + F.exp(p["score"] - acc["peak"])).alias("met"), (acc["floors"] + F.exp(p["floor"] - acc["peak"])).alias("floors"))

        def whole(acc: Column) -> Column:
            rest = base["total"] * F.exp(base["peak"] - acc["peak"]) - acc["floors"]
            return acc["peak"] + F.log(F.greatest(rest, F.lit(0.0)) + acc["met"])

        value = F.aggregate(f"c{i}", start, add, whole) - F.get(F.filter(f"c{i}", lambda p: p["neg"] == -F.col("label")), F.lit(0))["score"]
    return F.struct(
        F.lit(i).alias("candidate"), F.lit(float(a)).alias("alpha"), (-F.col(f"t{i}.neg")).cast("bigint").alias("prediction"),
        peak.alias("score"), value.alias("loss"),
    )
