"""How the sources of a language differ in their words, on run-length encoded count columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscat.llm.batches import runs
from corpuscat.operators.scale import lookup, rank_all
from corpuscat.session import cut_lineage

SUPPORT = 30  # documents of a language that a term must be in
TOP_TERMS = 50
SMOOTH, UNIT = 5, 1_000_000_000  # added to each count; the whole of a share
# UTF-8 as terms see it: A to Z in lower case, other ASCII but a to z a space; all other bytes belong to letters.
_SEEN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

LONG_TEXT = 1 << 20  # bytes of a text whose terms are listed at a time
HELD = 400_000  # counts that a task holds before it passes them on
BLOCK = 4_096  # places of the vocabulary in one piece of a column
TILE = 64  # sources that meet another such number at a time
LEADING = 8  # sources whose counts order a language's vocabulary


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of one text in their order, in lists of about ``LONG_TEXT`` bytes."""
    plain = text.translate(_SEEN)
    start = 0
    while len(plain) - start > LONG_TEXT:
        end = plain.find(b" ", start + LONG_TEXT)
        if end < 0:
            break
        yield plain[start:end].split()
        start = end
    yield plain[start:].split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group; a row without a term stands for the group."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [None, *n]
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string())]
            counts = [pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *counts], names=["lang", "source", "term", "n", "docs"])

    size = 0
    for batch in batches:
        # Texts leave Arrow one by one: a batch may hold very long ones.
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for terms in _terms(text.as_buffer().to_pybytes()):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(n) - before
            if size >= HELD:
                yield from flush()
                held.clear()
                size = 0
    yield from flush()


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(UNIT (count + SMOOTH) / (total + SMOOTH terms))`` in whole numbers; null without terms."""
    above = (count + F.lit(SMOOTH)).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = F.nullif((total + F.lit(SMOOTH) * terms).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    # The quotient of floor(a / b) is exact as (a - a % b) / b.
    return ((above - above % below) / below).cast("bigint") + F.lit(1)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each group's shares over one block of the vocabulary as runs: where each ends, and its value.

    The first row of a block has the block's bounds and the share of a term that the group lacks.
    """
    for table in runs(batches):
        table = table.combine_chunks()
        first = table.slice(0, 1).to_pylist()[0]
        low, size = first["low"], first["high"] - first["low"]
        values = np.full(size, 0 if first["p"] is None else first["p"], np.int64)
        rest = table.slice(1)
        values[rest["pos"].to_numpy() - low] = rest["p"].to_numpy()
        ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, size) if size else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([first[c]]) for c in ("lang", "source")), pa.array([first["block"]], pa.int64()), *(pa.array([first[c]], pa.int32()) for c in ("tile", "tiles")),
             pa.array([ends.tolist()], pa.list_(pa.int32())), pa.array([values[ends - 1].tolist()], pa.list_(pa.int64()))],
            names=["lang", "source", "block", "tile", "tiles", "ends", "values"],
        )


def run_distance(ends_a: np.ndarray, a: np.ndarray, ends_b: np.ndarray, b: np.ndarray) -> int:
    """Sum of absolute differences of two run-length encoded columns of one length.

    Between two neighbouring boundaries of either column both are constant, so one
    difference stands for all places there.
    """
    cuts = np.union1d(ends_a, ends_b)
    lengths = np.diff(cuts, prepend=0)
    apart = np.abs(a[np.searchsorted(ends_a, cuts)] - b[np.searchsorted(ends_b, cuts)])
    return int((apart * lengths).sum())


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of the pairs of sources that meet in a cell: two tiles, or one with itself."""
    for table in runs(batches):
        columns = table.select(["source", "tile", "ends", "values"]).to_pylist()
        for c in columns:
            c["ends"], c["values"] = np.array(c["ends"], np.int64), np.array(c["values"], np.int64)
        lang, alone = table["lang"][0].as_py(), len({c["tile"] for c in columns}) == 1 and table["alone"][0].as_py()
        one, other, value = [], [], []
        for i, a in enumerate(columns):
            for b in columns[i + 1 :]:
                if alone or a["tile"] != b["tile"]:
                    one.append(a["source"])
                    other.append(b["source"])
                    value.append(run_distance(a["ends"], a["values"], b["ends"], b["values"]))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(one), pa.string()), pa.array(one, pa.string()), pa.array(other, pa.string()), pa.array(value, pa.int64())], names=["lang", "one", "other", "value"])


def _group(lang: str = "lang", source: str = "source") -> Column:
    """One name for a pair of strings, whatever they hold."""
    return F.concat(F.octet_length(lang).cast("string"), F.lit(":"), F.col(lang), F.col(source))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", support: int = SUPPORT, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each (lang, source) group of ``docs`` differs.

    A language keeps the terms that occur in at least ``support`` of its documents. A group's
    share of a kept term is ``share`` of its count there, and the language's likewise.

    * ``part`` = ``pair``: ``item`` is another source of the language, ``value`` the sum over
      all kept terms of the absolute difference of both groups' shares (0 without terms).
    * ``part`` = ``term``: ``item`` is a kept term that the group has and uses more than the
      language, ``value`` the difference; the ``top`` ranks.

    Terms are counted within tasks and summed. Each language's vocabulary is put in the order
    of the counts in its largest sources, so that terms of equal counts, zeros above all, are
    neighbours. Groups become columns of runs over that order, cut in blocks of ``BLOCK``
    places; columns meet in cells of two tiles of ``TILE`` sources and one block, and a pair's
    distance is summed over the intersections of its runs. Nothing holds a whole column, a
    whole vocabulary or all sources of a language. All arithmetic is in whole numbers.

    Null texts, languages and sources are ``''``. Every group that occurs is there, also
    without terms. Equal values rank by the item's UTF-8 bytes. Repeated rows are documents
    each. An empty table gives an empty result; other columns are not read.
    """
    given = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    counted = docs.select(*given).mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    cells = cut_lineage(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    vocabulary = cells.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    vocabulary = cut_lineage(vocabulary.filter(F.col("docs") >= support).select("lang", "term", "total"))
    used = cells.filter("term is not null").join(vocabulary, ["lang", "term"]).select(_group().alias("group"), "lang", "source", "term", "n", "total")
    used = cut_lineage(used)

    # One row for each group, with its language's sums beside its own.
    sums = used.groupBy("group").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("terms"))
    whole = vocabulary.groupBy("lang").agg(F.sum("total").alias("lang_all"), F.count(F.lit(1)).alias("v"))
    groups = cells.filter("term is null").select(_group().alias("group"), "lang", "source").join(sums, "group", "left").join(whole, "lang", "left")
    groups = groups.fillna(0, ["all", "terms", "lang_all", "v"])
    by_size = Window.partitionBy("lang").orderBy(F.desc("all"), "source")
    groups = cut_lineage(groups.withColumn("at", F.row_number().over(by_size) - 1))
    facts = groups.select("group", "terms", "all", "lang_all", "v", "at")
    shares = lookup(used, facts, "group", "terms", complete=True)
    shares = cut_lineage(shares.select("group", "lang", "source", "term", "n", "at", share(F.col("n"), F.col("all"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_all"), F.col("v")).alias("q")))

    pair = _pair_distances(shares, groups)
    both = pair.unionByName(pair.select("lang", F.col("other").alias("one"), F.col("one").alias("other"), "value"))
    pairs = both.select("lang", F.col("one").alias("source"), F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    terms = shares.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = terms.withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def _pair_distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, one, other, value`` of every pair of sources of a language, once."""
    lead = [F.sum(F.when(F.col("at") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(LEADING)]
    order = shares.groupBy("lang", "term").agg(*lead)
    placed = rank_all(order, ["lang", *[F.col(f"c{i}") for i in range(LEADING)], F.col("term")], "pos").select("lang", "term", "pos")
    placed = cut_lineage(placed)
    first = placed.groupBy("lang").agg(F.min("pos").alias("low"), F.max("pos").alias("last"))

    # Every block of a language is there for each of its groups, if only with the share of no count.
    block = F.col("block")
    each = groups.join(first, "lang", "left").withColumn("from", F.coalesce(F.floor(F.col("low") / BLOCK), F.lit(0)))
    each = each.withColumn("to", F.coalesce(F.floor(F.col("last") / BLOCK), F.lit(0)))
    each = each.withColumn("tiles", F.max(F.floor(F.col("at") / TILE).cast("int") + 1).over(Window.partitionBy("lang")))
    heads = each.withColumn("block", F.explode(F.sequence("from", "to"))).select(
        "group", block.cast("bigint").alias("block"), F.lit(-1).cast("bigint").alias("pos"), share(F.lit(0).cast("bigint"), F.col("all"), F.col("v")).alias("p"),
        F.coalesce(F.greatest("low", block * BLOCK), F.lit(0)).cast("bigint").alias("low"),
        F.coalesce(F.least(F.col("last") + 1, (block + 1) * BLOCK), F.lit(0)).cast("bigint").alias("high"),
        "lang", "source", F.floor(F.col("at") / TILE).cast("int").alias("tile"), "tiles",
    )
    none = [F.lit(None).cast(t).alias(c) for c, t in (("low", "bigint"), ("high", "bigint"), ("lang", "string"), ("source", "string"), ("tile", "int"), ("tiles", "int"))]
    points = shares.select("group", "lang", "term", "p").join(placed, ["lang", "term"])
    points = points.select("group", F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block"), "pos", "p", *none)
    keyed = heads.unionByName(points).select(F.concat("group", F.lit(":"), block.cast("string")).alias("key"), "*")
    columns = keyed.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(
        _columns, "lang string, source string, block bigint, tile int, tiles int, ends array<int>, values array<bigint>"
    )
    columns = cut_lineage(columns)

    # A tile meets itself and every other tile of its language, block by block.
    met = columns.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    at = [F.least("tile", "o").cast("string"), F.greatest("tile", "o").cast("string"), block.cast("string"), F.col("lang")]
    met = met.select(F.concat_ws(":", *at).alias("cell"), "lang", "source", "tile", (F.col("tile") == F.col("o")).alias("alone"), "ends", "values")
    found = met.repartition("cell").sortWithinPartitions("cell", "source").mapInArrow(_pairs, "lang string, one string, other string, value bigint")
    return found.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
