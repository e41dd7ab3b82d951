"""Nearest neighbours of a stated query set by a block matrix join in int8."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscat.operators.scale import salted_join
from corpuscat.session import cut_lineage

NEAREST = 20
BLOCK_BYTES = 8 << 20  # of query vectors in double precision that one block holds
BLOCK_ROWS = 2_048  # query vectors in one block at most
TILE = 1_024  # candidates that meet a block at a time
CELLS = 3  # cells for each core that works at a time, at most
RUN_ROWS = 256  # candidates that a run should have at least
CHUNK = 1_024  # components whose int8 products sum exactly in single precision: 1024 * 127 * 127 < 2 ** 24


def _reader(kind: type):
    """Rows as bytes: a usable vector's components, and their digest; else nulls."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, keys = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = None if i is None or v is None or None in v else np.array(v, kind)
                good = a is not None and bool(np.isfinite(a).all()) and bool(a.any())
                raw = (a + kind(0)).tobytes() if good else None  # -0.0 is 0.0
                raws.append(raw)
                keys.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.binary()), pa.array(keys, pa.binary())], names=["id", "raw", "key"])

    return read


def _matrix(raws: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(np.float64)


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``codes, scale, rest, norm``: int8 codes of each row, their step, and norms for the error bound.

    A row is ``scale * codes`` and a remainder of norm ``rest``; ``norm`` is the row's own.
    """
    scale = np.abs(v).max(axis=1) / 127
    scale[scale == 0] = np.finfo(float).tiny  # a row of subnormal components
    codes = np.clip(np.rint(v / scale[:, None]), -127, 127)
    rest = np.linalg.norm(v - codes * scale[:, None], axis=1)
    return codes.astype(np.int8), scale, rest, np.linalg.norm(v, axis=1)


def tile_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of int8 rows, by chunks that single precision holds exactly."""
    out = np.zeros((len(a), len(b)))
    for s in range(0, a.shape[1], CHUNK):
        out += a[:, s : s + CHUNK].astype(np.float32) @ b[:, s : s + CHUNK].astype(np.float32).T
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of facing rows in double precision, summed in the order of the components."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return np.where(np.isnan(total), -np.inf, total)


class _Block:
    """Query vectors of one cell, each with a bounded list of its best candidates so far."""

    def __init__(self, keys: list[bytes], raws: list[bytes], kind: type, most: int):
        self.keys, self.most = keys, most
        self.v = _matrix(raws, kind)
        self.codes, self.scale, self.rest, self.norm = quantised(self.v)
        self.floor = np.full(len(keys), -np.inf)  # a candidate must reach the last of a full list
        self.owner = np.zeros(0, np.int64)
        self.score, self.id, self.row = np.zeros(0), None, np.zeros(0, np.int64)

    def meet(self, ids: np.ndarray, rows: np.ndarray, v: np.ndarray) -> None:
        codes, scale, rest, norm = quantised(v)
        with np.errstate(over="ignore", invalid="ignore"):
            self._meet(ids, rows, v, tile_products(self.codes, codes) * self.scale[:, None] * scale[None, :], rest, norm)

    def _meet(self, ids: np.ndarray, rows: np.ndarray, v: np.ndarray, near: np.ndarray, rest: np.ndarray, norm: np.ndarray) -> None:
        # x.y = (x' + r).(y' + s): what the codes leave out is at most |x||s| + |r||y| + |r||s|,
        # and a little for the rounding of both sums.
        bound = self.norm[:, None] * rest[None, :] + self.rest[:, None] * (norm + rest)[None, :]
        bound += 1e-12 * v.shape[1] * self.norm[:, None] * norm[None, :]
        upper = near + bound
        floor = self.floor
        if len(ids) >= self.most and np.isneginf(floor).any():  # lists are not full yet
            lower = near - bound
            reached = np.partition(np.where(np.isnan(lower), -np.inf, lower), len(ids) - self.most, axis=1)[:, len(ids) - self.most]
            floor = np.maximum(floor, reached)
        q, c = np.nonzero(~(upper < floor[:, None]))  # a bound that is no number drops nothing
        exact = np.empty(len(q))
        for s in range(0, len(q), 1 << 16):
            exact[s : s + (1 << 16)] = inner(self.v[q[s : s + (1 << 16)]], v[c[s : s + (1 << 16)]])
        better = exact >= self.floor[q]
        q, c, exact = q[better], c[better], exact[better]
        if len(q):
            self._keep(np.concatenate([self.owner, q]), np.concatenate([self.score, exact]), ids[c] if self.id is None else np.concatenate([self.id, ids[c]]), np.concatenate([self.row, rows[c]]))

    def _keep(self, owner, score, ids, rows) -> None:
        names = ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1]
        order = np.lexsort((rows, names, -score, owner))
        owner = owner[order]
        first = np.searchsorted(owner, owner, side="left")
        place = np.arange(len(owner)) - first
        kept = place < self.most
        order, owner, place = order[kept], owner[kept], place[kept]
        self.owner, self.score, self.id, self.row = owner, score[order], ids[order], rows[order]
        full = place == self.most - 1
        self.floor[owner[full]] = self.score[full]

    def lists(self, id_type: pa.DataType) -> pa.RecordBatch:
        edges = np.searchsorted(self.owner, np.arange(len(self.keys) + 1)).astype(np.int32)
        offsets = pa.array(edges, pa.int32())
        columns = [pa.array(self.score, pa.float64()), pa.array([] if self.id is None else self.id.tolist(), id_type), pa.array(self.row, pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(self.keys, pa.binary()), *[pa.ListArray.from_arrays(offsets, c) for c in columns]], names=["key", "scores", "ids", "rows"])


def _search(kind: type, most: int):
    """The best of each cell's candidates for each of its queries, which come before them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, block, waiting = None, None, ([], [])
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            cells, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
                if b == a:
                    continue
                if cells[a] != cell:
                    if block is not None:
                        yield block.lists(id_type)
                    cell, block, waiting = cells[a], None, ([], [])
                part = batch.slice(a, b - a)
                if sides[a] == 0:
                    waiting[0].extend(part.column(2).to_pylist())
                    waiting[1].extend(part.column(3).to_pylist())
                    continue
                if block is None:
                    if not waiting[0]:
                        continue
                    block = _Block(*waiting, kind, most)
                for s in range(0, b - a, TILE):
                    tile = part.slice(s, TILE)
                    block.meet(tile.column(4).to_numpy(zero_copy_only=False), tile.column(5).to_numpy(), _matrix(tile.column(3).to_pylist(), kind))
        if block is not None:
            yield block.lists(id_type)

    return search


def _merge(most: int):
    """One list of the ``most`` nearest from a query's sorted lists, by a heap over their heads."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {"scores": [], "ids": [], "rows": []}
            for lists in batch.column(1).to_pylist():
                runs = [list(zip(*(part[c] for c in ("scores", "ids", "rows")))) for part in lists]
                best = list(islice(heapq.merge(*runs, key=lambda e: (-e[0], e[1], e[2])), most))
                for k, c in enumerate(found):
                    found[c].append([e[k] for e in best])
            kinds = [batch.schema.field(1).type.value_type.field(c).type for c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(found.values(), kinds)]], names=["key", *found])

    return merge


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id_col, score``: the ``k`` rows of the largest inner product for each query row.

    ``is_query`` picks the queries among the rows of ``vectors`` (its columns are those of
    ``vectors``). All other rows of the same length are candidates, also other queries and
    rows that repeat the query's id; only its own row is not. Nearest come first, equal
    scores by the smaller id. Fewer candidates give fewer rows.

    Vectors become int8 codes with a step of their own. Blocks of queries meet runs of
    candidates in a grid of cells, of which each task has some; a run streams through a
    cell in tiles. A tile's integer products and the norms of what the codes leave out
    bound each inner product from both sides. Pairs whose upper bound is below the k-th lower
    bound, or below the list so far, are out; the others are computed anew from the original
    vectors in double precision. Sorted lists of the runs meet in a heap. Nothing is
    approximate: every list is the exact one.

    Of equal vectors the ``k + 1`` rows of the smallest ids stand for all, as ties go to
    them, and equal queries are searched once; so a vector that most rows repeat costs no
    more than another. Blocks have at most ``BLOCK_BYTES``, cells ``CELLS`` for each core.

    Rows without an id, and vectors that are null, empty, zero or hold null or non-finite
    components take no part. A product that is no number (infinities of both signs) counts
    as minus infinity. An empty table, or no query, gives an empty result; other columns
    are not read.
    """
    spark = vectors.sparkSession
    kind = np.float32 if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else np.float64
    id_kind = vectors.schema[id_col].dataType.simpleString()
    # Named apart from whatever columns the table has: only three are left.
    slim = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    read = slim.select("id", "v", "asks").mapInArrow(_with_flag(_reader(kind)), f"id {id_kind}, raw binary, key binary, asks boolean")
    base = cut_lineage(read.filter("key is not null").withColumn("row", F.monotonically_increasing_id()).withColumn("width", F.octet_length("raw")))

    most = k + 1  # a query's own row may be among the best
    first = F.row_number().over(Window.partitionBy("key").orderBy("id", "row"))
    candidates = base.select("key", "width", "raw", "id", "row").withColumn("r", first).filter(F.col("r") <= most).drop("r")
    asked = base.filter("asks").groupBy("key").agg(F.first("raw").alias("raw"), F.first("width").alias("width"), F.count(F.lit(1)).alias("rows"))
    asked = cut_lineage(asked)
    # One row for each length of vector.
    sizes = asked.groupBy("width").agg(F.count(F.lit(1)).alias("n")).join(base.groupBy("width").agg(F.count(F.lit(1)).alias("all")), "width").collect()
    if not sizes:
        return _result(base, None, k, id_col, id_kind)

    # Blocks and runs of each length: enough cells for all cores, or as many as the blocks need.
    itemsize, cells = np.dtype(kind).itemsize, CELLS * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks, runs = {}, {}
    for s in sizes:
        most_rows = max(64, min(BLOCK_ROWS, BLOCK_BYTES // (s["width"] // itemsize * 8)))
        blocks[s["width"]] = -(-s["n"] // most_rows)
        runs[s["width"]] = max(1, min(cells // blocks[s["width"]], -(-s["all"] // RUN_ROWS)))
    n_blocks, n_runs = _by_width(blocks), _by_width(runs)

    def cell(block: Column, run: Column) -> Column:
        return F.xxhash64("width", block, run)

    own_block = F.pmod(F.xxhash64("key"), n_blocks).cast("int")
    own_run = F.pmod(F.xxhash64("key", F.lit(3)), n_runs).cast("int")
    questions = asked.withColumn("run", F.explode(F.sequence(F.lit(0), n_runs - 1))).select(
        cell(own_block, F.col("run")).alias("cell"), F.lit(0).alias("side"), "key", "raw", F.lit(None).cast(id_kind).alias("id"), F.lit(0).cast("bigint").alias("row")
    )
    answers = candidates.filter(n_blocks.isNotNull()).withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1))).select(
        cell(F.col("block"), own_run).alias("cell"), F.lit(1).alias("side"), F.lit(None).cast("binary").alias("key"), "raw", "id", "row"
    )
    grid = questions.unionByName(answers).repartition("cell").sortWithinPartitions("cell", "side", "key")
    lists = f"key binary, scores array<double>, ids array<{id_kind}>, rows array<bigint>"
    found = cut_lineage(grid.mapInArrow(_search(kind, most), lists))
    # As many lists for a query as it has runs, at most ``cells``.
    together = found.groupBy("key").agg(F.collect_list(F.struct("scores", "ids", "rows")).alias("lists"))
    merged = cut_lineage(together.mapInArrow(_merge(most), lists).join(asked.select("key", F.col("rows").alias("n")), "key"))
    return _result(base, merged, k, id_col, id_kind)


def _with_flag(read):
    """``read`` over the first columns of each batch, with the last one beside its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in read(iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2)], names=[*out.schema.names, "asks"])

    return run


def _by_width(of: dict[int, int]) -> Column:
    """The number that belongs to a row's ``width``; null for a length without queries."""
    out = F.lit(None).cast("int")
    for width, n in of.items():
        out = F.when(F.col("width") == width, F.lit(n)).otherwise(out)
    return out


def _result(base: DataFrame, merged: DataFrame | None, k: int, id_col: str, id_kind: str) -> DataFrame:
    """Lists for distinct query vectors as rows for each query row, without its own row."""
    if merged is None:
        return base.sparkSession.createDataFrame([], f"query_id {id_kind}, rank int, `{id_col}` {id_kind}, score double")
    queries = base.filter("asks").select(F.col("id").alias("query_id"), F.col("row").alias("own"), "key")
    listed = salted_join(queries, merged, "key", "n", F.col("own"))
    entries = F.filter(F.arrays_zip("rows", "ids", "scores"), lambda e: e["rows"] != F.col("own"))
    each = listed.select("query_id", F.posexplode(F.slice(entries, 1, k)).alias("place", "e"))
    return each.select("query_id", (F.col("place") + 1).alias("rank"), F.col("e.ids").alias(id_col), F.col("e.scores").alias("score"))


def recall(vectors: DataFrame, found: DataFrame, is_query: Column, k: int = NEAREST, sample: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """Share of the true nearest scores that ``found`` holds, for a stated number of queries.

    The ``sample`` queries of the smallest hashes are compared with all rows in plain double
    precision expressions; a score counts as found once for each time it occurs.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = rows.filter(good & F.exists("v", lambda x: x != 0))
    asked = rows.filter("asks").orderBy(F.xxhash64("id")).limit(sample).select(F.col("id").alias("q"), F.col("v").alias("w"))
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    pairs = rows.join(F.broadcast(asked), (F.col("id") != F.col("q")) & (F.size("v") == F.size("w"))).select("q", "id", dot.alias("score"))
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k)
    hit = best.join(found.select(F.col("query_id").alias("q"), F.col(id_col).alias("id"), F.lit(1).alias("hit")).distinct(), ["q", "id"], "left")
    row = hit.agg(F.count(F.lit(1)), F.count("hit")).first()
    return row[1] / row[0] if row[0] else 1.0
