"""Mix sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscat.llm.exact import one_space
from corpuscat.operators.scale import rank_all, salted_join
from corpuscat.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
FAN_BITS = 6  # a node of the reduction tree joins 64 parts below it
SIZE_STEPS = 8  # size classes per doubling
CHUNK_BITS = 16  # of the rows of one content that are numbered together
_UNIT = "struct<size:bigint,h:bigint,id:{id},source:string,content:bigint,n:bigint,total:bigint,target:double,base:bigint,p:double,debt:double>"


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    flat = F.btrim(one_space(text), F.lit(" "))
    return F.when(flat == "", F.lit(0)).otherwise(F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to ``source, source_size, rows``: weighted shares below a ceiling.

    Sources weigh by their rank in code-point order, null last. What a source cannot take
    is shared among the rest by weight, until none is above its ceiling. Each round is one
    sum over the sources; only two numbers reach the driver.
    """
    ranked = rank_all(sources, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(ranked.select("source", "source_size", "rows", weight.alias("_w"), (F.col("source_size") * most).alias("_top")))
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("_w") * F.lit(level) > F.col("_top")
        s = ranked.agg(
            F.count(F.when(full, 1)).alias("n"),
            F.sum(F.when(full, F.col("_top")).otherwise(0.0)).alias("taken"),
            F.sum(F.when(full, 0.0).otherwise(F.col("_w"))).alias("w"),
        ).first()
        if s["n"] == capped or not s["w"]:
            break
        capped, level = s["n"], (total - s["taken"]) / s["w"]
    target = F.least(F.col("_top"), F.col("_w") * F.lit(float(level or 0.0)))
    return cut_lineage(ranked.select("source", "source_size", "rows", target.alias("target")))


def _uniform(seed: int, a: Column, b: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), a, b), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _struct(u: Column, unit: str, base: Column, p: Column, debt: Column) -> Column:
    kept = [u[k].alias(k) for k in ("size", "h", "id", "source", "content", "n", "total", "target")]
    return F.struct(*kept, base.cast("bigint").alias("base"), p.alias("p"), debt.alias("debt")).cast(unit)


def _pair_up(units: Column, seed: int, unit: str) -> Column:
    """Pair the units in order: ``done`` has those rounded, ``rest`` the one still open.

    Each step moves the mass of two open units until one holds 0 or 1 copies more, drawn so
    that the expectation of both stays. The words that a step gives or takes, as the two
    differ in size, are the debt of the unit that stays open.
    """
    start = F.struct(F.lit(None).cast(unit).alias("rest"), F.array().cast(f"array<{unit}>").alias("done"))

    def step(acc: Column, e: Column) -> Column:
        a = acc["rest"]
        s = a["p"] + e["p"]
        over = s >= 1.0
        # The chance that the open unit gets the larger part.
        chance = F.when(over, (1.0 - e["p"]) / (2.0 - s)).when(s > 0, a["p"] / s).otherwise(0.0)  # units that came out even have nothing to move
        first = F.coalesce(_uniform(seed, a["h"], e["h"]) < chance, F.lit(False))
        settled, left = F.when(first == over, a).otherwise(e), F.when(first == over, e).otherwise(a)
        got, p = F.when(over, 1).otherwise(0), F.when(over, s - 1.0).otherwise(s)
        debt = a["debt"] + e["debt"] + (got * settled["size"] + p * left["size"]) - (a["p"] * a["size"] + e["p"] * e["size"])
        rest = F.when(a.isNull(), e).otherwise(_struct(left, unit, left["base"], p, debt))
        more = F.array(_struct(settled, unit, settled["base"] + got, F.lit(0.0), F.lit(0.0)))
        done = F.when(a.isNull(), acc["done"]).otherwise(F.concat(acc["done"], more))
        return F.struct(rest.cast(unit).alias("rest"), done.cast(f"array<{unit}>").alias("done"))

    return F.aggregate(units, start.cast(f"struct<rest:{unit},done:array<{unit}>>"), step)


def _settle(units: Column, seed: int, unit: str) -> Column:
    """Round the last units of a source, largest first, passing words from one to the next.

    A unit is drawn, and what it takes above or below its expectation, with all debts,
    changes the probability of the next, smaller one; past 0 or 1 that one is integral and
    passes on the rest. What no unit can take any more is less than the smallest of them.
    """
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast(f"array<{unit}>").alias("done"))

    def step(acc: Column, e: Column) -> Column:
        mass = e["p"] * e["size"] - e["debt"] + acc["carry"]
        got = F.when(_uniform(seed, e["h"], F.lit(-1).cast("bigint")) < mass / e["size"], 1).otherwise(0)
        more = F.array(_struct(e, unit, e["base"] + got, F.lit(0.0), F.lit(0.0)))
        return F.struct((mass - got * e["size"]).cast("double").alias("carry"), F.concat(acc["done"], more).cast(f"array<{unit}>").alias("done"))

    return F.aggregate(units, start.cast(f"struct<carry:double,done:array<{unit}>>"), step)["done"]


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``no``, the place of a row among those of its content, which are alike in all columns.

    Rows are counted by content, within tasks first, and written out again from the counts,
    in chunks of ``2 ** CHUNK_BITS`` over many tasks. So nothing ranks them, a content that
    most rows share included, and the numbers do not depend on how rows are dealt.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright(F.col("_n") - 1, CHUNK_BITS))))
    start = F.shiftleft("_chunk", CHUNK_BITS)
    end = F.least(F.col("_n"), start + (1 << CHUNK_BITS)) - 1
    return chunks.repartition("id", "content", "_chunk").select(*rows.columns, F.explode(F.sequence(start, end)).alias("no"))


def choose_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """One row per document: ``id_col, size, source_size, target, copies, taken``.

    Every document of a source expects target / source_size copies. The whole part is
    given; the fraction is settled by pivotal rounding over a tree: units of one source
    and of nearly one size, sorted by size, are paired within blocks of about 64, and each
    block passes one open unit up. The last of each size class meet per source, where they
    also balance the words that unequal pairs have moved, so that the words taken differ
    from a target by less than a small text if the source has any. Draws depend on ids and
    texts only, so reruns agree. No document has more than ``ceil(most)`` copies.

    Blocks are cut by a hash of id, text and the row's number among those alike, so a source
    with most of the rows is many blocks, and so are rows that share a null id, a text or
    both. Null texts have size 0, null sources are one source, null or repeated ids are
    units like others; empty tables give empty results. Other columns play no part.
    """
    chosen = _chosen(docs, id_col, text_col, source_col, weights, share, most, seed)
    return chosen.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _chosen(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """``choose_copies`` with ``source`` and ``content``, a hash of the text, beside each ``id``."""
    kind = docs.schema[id_col].dataType.simpleString()
    unit = _UNIT.format(id=kind)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), F.xxhash64(F.col(f"`{text_col}`")).alias("content"))
    rows = cut_lineage(_numbered(rows))
    totals = cut_lineage(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")))
    # A join has no null key: the mark sets null apart from every text.
    mark = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    targets = cut_lineage(source_targets(totals, weights, share, most).withColumn("_key", mark).drop("source"))
    placed = salted_join(rows.withColumn("_key", mark), targets, "_key", "rows", F.xxhash64("id", "content", "no"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    h = F.xxhash64(F.lit(seed), "id", "size", "content", "no")
    group = F.when(F.col("size") > 0, F.floor(F.log2("size") * SIZE_STEPS)).otherwise(-1).cast("int")
    base = F.floor(rate).cast("bigint")
    whole = rate - base
    units = placed.select("_key", group.alias("_class"), F.struct(
        "size", h.alias("h"), "id", "source", "content", F.lit(1).cast("bigint").alias("n"), F.col("source_size").alias("total"), "target", base.alias("base"), whole.alias("p"), F.lit(0.0).alias("debt"),
    ).cast(unit).alias("u"))
    open_ = (F.col("u.p") > 0) & (F.col("u.size") > 0)
    units = cut_lineage(units)
    settled = [units.filter(~open_).select("u")]
    level = units.filter(open_)
    largest = level.groupBy("_key", "_class").count().agg(F.max("count")).first()[0] or 1
    depth = max(1, math.ceil(math.log2(largest) / FAN_BITS))
    for up in range(depth - 1, -1, -1):
        # Blocks by the leading hash bits, fewer on each level, at last one a size class.
        block = F.shiftrightunsigned(F.col("u.h"), 64 - FAN_BITS * up) if up else F.lit(0).cast("bigint")
        nodes = level.groupBy("_key", "_class", block.alias("_block")).agg(F.sort_array(F.collect_list("u")).alias("units"))
        nodes = cut_lineage(nodes.select("_key", "_class", _pair_up(F.col("units"), seed, unit).alias("f")))
        settled.append(nodes.select(F.explode("f.done").alias("u")))
        level = nodes.select("_key", "_class", F.col("f.rest").alias("u"))
    # One open unit for each source and size class: at most a few hundred a source.
    last = level.groupBy("_key").agg(F.sort_array(F.collect_list("u"), asc=False).alias("units"))
    settled.append(last.select(F.explode(_settle(F.col("units"), seed, unit)).alias("u")))
    out = ["u.id", "u.source", "u.content", "u.size", F.col("u.total").alias("source_size"), "u.target", F.col("u.base").alias("copies")]
    result = settled[0].select(*out)
    for part in settled[1:]:
        result = result.unionByName(part.select(*out))
    return result


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``choose_copies`` says.

    Rows alike in id, text and source share their copies evenly; where some get one more
    than others, the order is that of a hash of their other columns, maps aside. Texts
    without words have the whole part of their source's copies, null ids and sources are
    values like others. An empty table gives an empty result. Columns may have any names.
    """
    chosen = _chosen(docs, id_col, text_col, source_col, **options).groupBy("id", "source", "content")
    chosen = chosen.agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike"))
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(*plain).alias("hash"),
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.xxhash64(F.col(f"`{text_col}`")).alias("content"),
    )
    joined = rows.join(chosen, [rows[c].eqNullSafe(chosen[c]) for c in ("id", "source", "content")]).select("row", "hash", chosen["id"], chosen["source"], chosen["content"], "copies", "alike")
    # Only rows alike in id, source and text meet in a window.
    rank = F.row_number().over(Window.partitionBy("id", "source", "content").orderBy("hash"))
    more = F.when(F.col("alike") == 1, 1).otherwise(rank) <= F.col("copies") % F.col("alike")
    each = joined.withColumn("each", (F.floor(F.col("copies") / F.col("alike")) + more.cast("int")).cast("int")).filter("each > 0")
    return each.select("row", F.explode(F.sequence(F.lit(1), F.col("each")))).select("row.*")
