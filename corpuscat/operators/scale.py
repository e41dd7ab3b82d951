"""Building blocks that keep hot keys and large dimension tables off any single task.

Every size bound used for a broadcast or a driver-side list is checked here, and
each check has an exact distributed way for the case that it fails.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscat.session import cut_lineage

# What may be broadcast, by measured size.
BROADCAST_BYTES = 64 << 20
# Dimension tables up to this size may become literals in a plan.
LITERAL_ROWS = 2_000
KEY_BYTES = 256

# Inputs up to this size are dealt over the cores when they come in too few files.
SPREAD_BYTES = 1 << 30

_POSITION_BITS = 33  # layout of monotonically_increasing_id


def bounded_rows(df: DataFrame, max_rows: int = LITERAL_ROWS) -> list[Row] | None:
    """The rows of ``df`` if it has at most ``max_rows`` narrow ones, else None."""
    strings = [c for c, t in df.dtypes if t == "string"]
    wide = F.lit(False)
    for c in strings:
        wide = wide | (F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) > KEY_BYTES)
    flagged = df.withColumn("_wide", wide)
    for c in strings:
        flagged = flagged.withColumn(c, F.when(~F.col("_wide"), F.col(f"`{c}`")))
    rows = flagged.limit(max_rows + 1).collect()
    if len(rows) > max_rows or any(r["_wide"] for r in rows):
        return None
    return [Row(**{c: r[c] for c in df.columns}) for r in rows]


def spread(df: DataFrame) -> DataFrame:
    """Deal rows of few, small files over all cores before costly work per row.

    Only an input below ``SPREAD_BYTES`` is moved; a large one already comes in many parts.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if planned_bytes(df) > SPREAD_BYTES or len(df._jdf.inputFiles()) >= want:
        return df
    return df.repartition(want)


def planned_bytes(df: DataFrame) -> int:
    """The planner's size of ``df``: of its files for a stored table, else an upper guess."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def row_bytes(df: DataFrame) -> Column:
    """Size of a row in memory: strings and arrays as they are, 16 bytes for other fields."""
    total = F.lit(48)
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind == "array":
            each = 32 + sum(_inner_bytes(c, g) for g in _listed(f.dataType))
            total = total + F.coalesce(F.greatest(F.size(c), F.lit(0)) * each, F.lit(0))
        else:
            total = total + 16
    return total


def _listed(kind: T.ArrayType) -> list[str]:
    """The fields of an array's elements that are arrays themselves."""
    return [f.name for f in kind.elementType.fields if isinstance(f.dataType, T.ArrayType)] if isinstance(kind.elementType, T.StructType) else []


def _inner_bytes(c: Column, field: str) -> Column:
    """Of an array within an array the longest counts for all: 8 bytes for each element."""
    longest = F.array_max(F.transform(c, lambda e: F.size(e[field])))
    return F.coalesce(F.greatest(longest, F.lit(0)) * 8, F.lit(0))


def heaviest(table: DataFrame, weight: str, size: Column, max_bytes: int) -> tuple[bool, int | None]:
    """Whether ``table`` measures at most ``max_bytes``; if not, from which ``weight`` on its rows do.

    Weights are taken by eighths of a power of two, at most a few hundred numbers. There is no
    such weight where its rows have less than half of all weight.
    """
    step = F.floor(F.log2(F.col(weight)) * 8).alias("step")
    found = table.groupBy(step).agg(F.sum(size).alias("bytes"), F.min(weight).alias("least"), F.sum(weight).alias("weight")).collect()
    if sum(r["bytes"] for r in found) <= max_bytes:
        return True, None
    total, held, least = 0, 0, None
    for r in sorted((r for r in found if r["step"] is not None), key=lambda r: -r["step"]):
        total += r["bytes"]
        if total > max_bytes:
            break
        held, least = held + r["weight"], r["least"]
    return False, least if 2 * held >= sum(r["weight"] or 0 for r in found) else None


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    weight: str,
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    bounded: bool = False,
    complete: bool = False,
) -> DataFrame:
    """Join many ``rows`` to a stored ``table`` with one row per ``key``, safe under hot keys.

    ``weight`` is the table's column saying how often a key occurs in ``rows``. A table
    that measures at most ``max_bytes`` is broadcast. Of a larger one the heaviest keys are,
    as many as measure ``max_bytes``, if they stand for half of the rows at least: words and
    the like have most of their rows in few keys, and these rows stay where they are. The
    other rows go through ``salted_join``. So ``rows`` are read twice, and should be stored
    if they are costly. ``how`` is inner, left or left_semi; the result has the columns of
    ``rows`` plus, unless semi, the table's other columns without ``weight``. ``bounded``
    says that the caller has checked the size.

    A left join also has to pass rows whose key the table lacks, and such a key may be
    heavy too, so keys are counted in ``rows``; ``complete`` says that the table has every
    key and saves this pass.
    """
    payload = [] if how == "left_semi" else [c for c in table.columns if c not in (key, weight)]
    slim = table.select(key, *payload)
    small, least = (True, None) if bounded else heaviest(table, weight, row_bytes(slim), max_bytes)
    if small:
        return rows.join(F.broadcast(slim), key, how).select(*rows.columns, *payload)
    if least is not None:
        head = F.broadcast(table.filter(F.col(weight) >= least).select(key, *payload))
        kept = rows.join(head, key, "left_semi" if how == "left_semi" else "inner").select(*rows.columns, *payload)
        rows = rows.join(head, key, "left_anti").select(*rows.columns)
        table = table.filter(F.coalesce(F.col(weight) < least, F.lit(True)))
        return kept.unionByName(_by_salts(rows, table, key, weight, how, complete))
    return _by_salts(rows, table, key, weight, how, complete)


def _by_salts(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str, complete: bool) -> DataFrame:
    weighed = table
    if how == "left" and not complete:
        # Keys that the table lacks may be heavy too: count them where they occur.
        weighed = cut_lineage(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(weight)))
    plain = [c for c, t in rows.dtypes if not t.startswith(("array", "map", "struct"))]
    return salted_join(rows, table, key, weight, F.xxhash64(*plain), how, weighed)


def salted_join(
    rows: DataFrame, table: DataFrame, key: str, weight: str, spread_by: Column, how: str = "inner", weighed: DataFrame | None = None
) -> DataFrame:
    """Join many ``rows`` to a stored ``table`` with one row per ``key``, no key in one task.

    ``weight`` says how many rows each key has, in ``table`` or in ``weighed(key, weight)``.
    A key with more than a quarter of a partition's even share is dealt over as many salts
    as it has quarters, rounded up to a power of two, and only such keys' table rows are
    repeated. At most four keys for each partition can be that heavy; the driver takes only
    their hashes, and they stand in the plan as sets, one for each number of salts.
    ``spread_by`` must depend on the row alone, so that a task that runs again deals alike.
    The result has the columns of ``rows`` and, unless semi, the table's others.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weighed = table if weighed is None else weighed
    total = weighed.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    limit = total // (4 * parts) + 1
    heavy: dict[int, set[int]] = {}
    for h, n in weighed.filter(F.col(weight) > limit).select(F.xxhash64(key), F.col(weight)).collect():
        heavy.setdefault(1 << (int(-(-n // limit)) - 1).bit_length(), set()).add(h)
    salts = F.lit(1)
    for n, hashes in sorted(heavy.items()):
        salts = F.when(F.expr(f"_key_hash IN ({', '.join(f'{h}L' for h in sorted(hashes))})"), F.lit(n)).otherwise(salts)

    def marked(df: DataFrame, salt: Callable[[Column], Column]) -> DataFrame:
        return df.withColumn("_key_hash", F.xxhash64(key)).withColumn("_salt", salt(salts)).drop("_key_hash")

    # Rows without a key find nothing, wherever they go.
    many = marked(rows, lambda n: F.pmod(F.xxhash64(spread_by), F.when(F.col(key).isNull(), F.lit(parts)).otherwise(n)).cast("int"))
    one = marked(table.drop(weight), lambda n: F.explode(F.sequence(F.lit(0), n - 1)))
    payload = [] if how == "left_semi" else [c for c in table.columns if c not in (key, weight)]
    return many.join(one, [key, "_salt"], how).select(*rows.columns, *payload)


def range_placed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` sorted over all partitions and stored, with its block and place in the block."""
    pos = F.col("_pos")
    placed = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    return (
        placed.withColumn("_block", F.shiftright(pos, _POSITION_BITS).cast("int"))
        .withColumn("_place", pos.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_pos")
    )


def block_offsets(placed: DataFrame, size: Column, start: int = 0) -> Column:
    """Total ``size`` of all rows in earlier blocks, plus ``start``, from one sum per block."""
    sizes = {r["_block"]: r["s"] for r in placed.groupBy("_block").agg(F.sum(size).alias("s")).collect()}
    offsets, total = [], start
    for b in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(b, 0)
    if not offsets:
        return F.lit(start).cast("bigint")
    return F.get(F.array(*[F.lit(o).cast("bigint") for o in offsets]), F.col("_block"))


def rank_all(df: DataFrame, order: Sequence[Column], out: str, start: int = 0) -> DataFrame:
    """Add the 0-based position of each row in a total ``order``, plus ``start``.

    Range-partitioned sort and per-block offsets; only one count per block reaches the
    driver, where a window without partitioning would send all rows to one task.
    """
    placed = range_placed(df, order)
    first = block_offsets(placed, F.lit(1), start)
    return placed.withColumn(out, (first + F.col("_place")).cast("bigint")).drop("_block", "_place")


def total_before(df: DataFrame, order: Sequence[Column], size: str, out: str) -> DataFrame:
    """Add the sum of ``size`` over all rows earlier in a total ``order``."""
    placed = range_placed(df, order)
    upto = F.sum(size).over(Window.partitionBy("_block").orderBy("_place"))
    first = block_offsets(placed, F.col(size))
    return placed.withColumn(out, first + upto - F.col(size)).drop("_block", "_place")
