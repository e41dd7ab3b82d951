"""Near copies of embeddings by NN-descent over a neighbour graph."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscat.llm.batches import runs
from corpuscat.llm.links import Groups, connected
from corpuscat.operators.scale import salted_join
from corpuscat.session import cut_lineage

SIMILAR = 0.93
NEIGHBOURS = 8  # length of a neighbour list at first
STARTS, CELL = 6, 48  # random cuttings that start the graph, at least, and vectors aimed at in a cell
MISS = 0.02  # share of pairs at the threshold that no cutting may keep together
ALL_BLOCK = 2_048  # vectors compared in one piece where all pairs of a label are
BLOCK = 512  # vectors compared in one piece
ROUNDS = 6  # of neighbours-of-neighbours joins at most, for one list length
ENOUGH = 0.001  # a round that changes a smaller share of the lists' entries is the last
AUDIT, AUDIT_MOST, AUDIT_BYTES = 256, 16_384, 32 << 20  # vectors audited against all others, at first and at most
AUDIT_LINKED = 64  # audited vectors that must have a link for the audit to count
RECALL, ENLARGE = 0.98, 3  # audited recall to reach, and how often lists double for it


def _unit(raw: list[bytes], kind: type) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _reader(kind: type):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, keys, spaces = [], [], []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                a = None if v is None or label is None or None in v else np.array(v, kind)
                wide = None if a is None else a.astype(np.float64)
                good = a is not None and len(a) and bool(np.isfinite(wide).all()) and 0 < np.linalg.norm(wide) < np.inf
                space = f"{label}:{len(a)}" if good else None
                spaces.append(space)
                raws.append((a + kind(0)).tobytes() if good else None)  # -0.0 is 0.0
                keys.append(hashlib.blake2b(space.encode() + b"|" + raws[-1], digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spaces, pa.string()), pa.array(raws, pa.binary()), pa.array(keys, pa.binary())], names=["id", "space", "raw", "key"])

    return read


def _cuttings(bits: int, similar: float) -> int:
    """Cuttings by ``bits`` planes after which a pair at the threshold has shared a cell, but for ``MISS``."""
    together = (1 - math.acos(max(-1.0, min(1.0, similar))) / math.pi) ** bits
    return STARTS if together >= 1 else max(STARTS, math.ceil(math.log(MISS) / math.log1p(-together)))


def _cells(kind: type, seed: tuple[int, ...], similar: float):
    """Each vector's cell in each of several cuttings by random planes, about ``CELL`` to a cell."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            spaces, raws, sizes = (batch.column(k).to_pylist() for k in (1, 2, 4))
            out_cell, out_row = [], []
            width = np.dtype(kind).itemsize
            for d in {len(r) // width for r in raws}:
                rows = [i for i, r in enumerate(raws) if len(r) == d * width]
                v = _unit([raws[i] for i in rows], kind)
                bits = np.array([max(0, math.ceil(math.log2(sizes[i] / CELL))) if sizes[i] > CELL else 0 for i in rows])
                many = {b: _cuttings(b, similar) for b in set(bits.tolist())}
                cuttings = np.array([many[b] for b in bits.tolist()])
                for t in range(max(many.values())):
                    if (d, t) not in planes:
                        planes[d, t] = np.random.default_rng([*seed, d, t]).standard_normal((40, d))
                    at = np.flatnonzero(cuttings > t)
                    sides = (v[at] @ planes[d, t].T > 0) & (np.arange(40)[None, :] < bits[at][:, None])
                    code = (sides * (1 << np.arange(40, dtype=np.int64))).sum(axis=1)
                    own = [rows[i] for i in at.tolist()]
                    out_cell += [f"{spaces[i]}/{t}/{c}" for i, c in zip(own, code.tolist())]
                    out_row += own
            take = pa.array(out_row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out_cell, pa.string()), *[batch.column(k).take(take) for k in (0, 2, 3)]], names=["cell", "id", "raw", "copies"])

    return cut


def _start(kind: type, k: int):
    """Each vector's best ``k`` others within its cell, in blocks if the cell is large."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches):
            for s in range(0, cell.num_rows, BLOCK):
                part = cell.slice(s, BLOCK)
                if part.num_rows < 2:
                    continue
                v = _unit(part["raw"].to_pylist(), kind)
                sims = v @ v.T
                np.fill_diagonal(sims, -2)
                top = np.argsort(-sims, axis=1)[:, : min(k, part.num_rows - 1)]
                yield _entries(part["id"], part["copies"], np.repeat(np.arange(len(v)), top.shape[1]), top.ravel(), sims)

    return best


def _entries(ids, copies, x: np.ndarray, y: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    copies = copies.combine_chunks() if isinstance(copies, pa.ChunkedArray) else copies
    arrays = [ids.take(pa.array(x)), pa.array(sims[x, y], pa.float64()), ids.take(pa.array(y)), copies.take(pa.array(y))]
    return pa.RecordBatch.from_arrays(arrays, names=["x", "sim", "y", "copies"])


def _local_join(kind: type):
    """New pairs among the neighbours of each centre that improve one of their lists."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 0, 4_000):
            table = table.combine_chunks()
            centre = table["u"].to_pylist()
            edges = [0, *[i for i in range(1, len(centre)) if centre[i] != centre[i - 1]], len(centre)]
            fresh, least = table["fresh"].to_numpy(), table["least"].to_numpy()
            raws = table["raw"].to_pylist()
            xs, ys, values = [], [], []
            for a, b in zip(edges, edges[1:]):
                if b - a < 2 or not fresh[a:b].any():
                    continue
                v = _unit(raws[a:b], kind)
                sims = v @ v.T
                useful = (fresh[a:b][:, None] | fresh[a:b][None, :]) & (sims > least[a:b][:, None])
                np.fill_diagonal(useful, False)
                i, j = np.nonzero(useful)
                xs.append(i + a)
                ys.append(j + a)
                values.append(sims[i, j])
            if not xs:
                continue
            x, y = np.concatenate(xs), np.concatenate(ys)
            ids, copies = table["v"].combine_chunks(), table["copies"].combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), pa.array(np.concatenate(values)), ids.take(pa.array(y)), copies.take(pa.array(y))], names=["x", "sim", "y", "copies"])

    return join


def _count_links(kind: type, similar: float):
    """Copies that each vector of side 0 links with, among those of side 1 in its block pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches):
            side, v = table["side"].to_numpy(), _unit(table["raw"].to_pylist(), kind)
            asks, has = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            ids = np.array(table["id"].to_pylist(), object)
            linked = (v[asks] @ v[has].T >= similar) & (ids[asks][:, None] != ids[has][None, :])
            n = linked.astype(np.float64) @ table["copies"].to_numpy()[has].astype(np.float64)
            ask = table["id"].combine_chunks().take(pa.array(asks))
            yield pa.RecordBatch.from_arrays([ask, pa.array(n.astype(np.int64))], names=["id", "n"])

    return count


class _Graph:
    """Neighbour lists of representatives: ``x, nb``, best first, as a stored table."""

    def __init__(self, reps: DataFrame, kind: type, id_kind: str, similar: float, seed: int):
        self.reps, self.kind, self.similar = reps, kind, similar
        self.schema = f"x {id_kind}, sim double, y {id_kind}, copies bigint"
        self.id_kind, self.seed = id_kind, seed
        self.k = 0
        self.table: DataFrame | None = None

    def enlarge(self, k: int) -> None:
        """Lists of ``k`` entries, from the cells of new planes and whatever the lists hold."""
        cells = self.reps.mapInArrow(_cells(self.kind, (self.seed, k), self.similar), f"cell string, id {self.id_kind}, raw binary, copies bigint")
        cells = cells.repartition("cell").sortWithinPartitions("cell", F.xxhash64("id"))
        found = cells.mapInArrow(_start(self.kind, k), self.schema)
        old = None if self.table is None else self.entries().drop("fresh")
        self.k = k
        self.table = self._best((found if old is None else found.unionByName(old)).withColumn("fresh", F.lit(True)))

    def _best(self, entries: DataFrame) -> DataFrame:
        # An entry found twice is as old as the first; a list holds few, so its rows fit.
        one = entries.groupBy("x", "y").agg(F.max("sim").alias("sim"), F.max("copies").alias("copies"), F.min("fresh").alias("fresh"))
        order = Window.partitionBy("x").orderBy(F.desc("sim"), "y")
        top = one.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= self.k)
        return cut_lineage(top.select("x", "y", "sim", "copies", "fresh"))

    def entries(self) -> DataFrame:
        return self.table

    def links(self) -> DataFrame:
        return self.table.filter(F.col("sim") >= self.similar)

    def refine(self) -> None:
        """Join neighbours of neighbours until a round changes hardly any list."""
        for _ in range(ROUNDS):
            table = self.table
            forward = table.select(F.col("x").alias("u"), F.col("y").alias("v"), "fresh")
            nearest = Window.partitionBy("y").orderBy(F.desc("sim"), "x")
            back = table.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= self.k)
            back = back.select(F.col("y").alias("u"), F.col("x").alias("v"), "fresh")
            members = cut_lineage(forward.unionByName(back).groupBy("u", "v").agg(F.max("fresh").alias("fresh")))
            # The entry that a new one must beat, where the list is full.
            least = table.groupBy("x").agg(F.min("sim").alias("s"), F.count(F.lit(1)).alias("c"))
            least = least.select(F.col("x").alias("v"), F.when(F.col("c") >= self.k, F.col("s")).otherwise(-2.0).alias("least"))
            uses = members.groupBy("v").agg(F.count(F.lit(1)).alias("uses"))
            vectors = self.reps.select(F.col("id").alias("v"), "raw", "copies").join(least, "v", "left").join(uses, "v")
            vectors = cut_lineage(vectors.withColumn("least", F.coalesce("least", F.lit(-2.0))))
            joined = salted_join(members, vectors, "v", "uses", F.col("u"))
            better = joined.repartition("u").sortWithinPartitions("u").mapInArrow(_local_join(self.kind), self.schema)
            old = table.withColumn("fresh", F.lit(False))
            self.table = self._best(old.unionByName(better.withColumn("fresh", F.lit(True))))
            total, new = self.table.agg(F.count(F.lit(1)), F.count_if("fresh")).first()
            if new <= ENOUGH * total:
                break


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 similar: float = SIMILAR, seed: int = 5) -> DataFrame:
    """One row per row: ``id_col, n_links, component_id, kept, audit_recall``.

    Vectors of one label (and one length) link when their cosine, in double precision, is
    at least ``similar``. Equal vectors are one representative. Neighbour lists start from
    random cuttings and are refined by joining neighbours of neighbours. A sample that holds enough
    linked vectors is audited against all; while its recall is low, all lists double. If that
    does not help, or a large sample has too few linked vectors to judge by, all pairs of
    each label are compared, in blocks, and the recall is 1. A list that is
    saturated, all links, is enlarged to its whole component, whose members are compared
    in blocks, so their counts are exact. ``audit_recall`` is the recall of the last audit.

    Null labels, and vectors that are null, zero or hold null or non-finite components,
    link with nothing. Rows that repeat an id and vector count as vectors each; rows with
    null ids have a null component. Empty tables give empty results; other columns are not
    read.
    """
    kind = np.float32 if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else np.float64
    id_kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vec_col}`").alias("v"))
    base = cut_lineage(rows.mapInArrow(_reader(kind), f"id {id_kind}, space string, raw binary, key binary"))
    good = base.filter("key is not null and id is not null")
    reps = good.groupBy("key").agg(F.min("id").alias("id"), F.first("space").alias("space"), F.first("raw").alias("raw"), F.count(F.lit(1)).alias("copies"))
    reps = cut_lineage(reps)
    sizes = cut_lineage(reps.groupBy("space").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.col("n")))
    reps = cut_lineage(salted_join(reps, sizes, "space", "n", F.col("id")).select("id", "space", "raw", "copies", "size", "key"))
    graph = _Graph(reps, kind, id_kind, similar, seed)
    true, audited = _audited(reps, kind, similar)
    k, recall = NEIGHBOURS, 0.0
    for _ in range(ENLARGE if audited else 0):
        graph.enlarge(k)
        graph.refine()
        links = cut_lineage(graph.links())
        component = cut_lineage(connected(links.select(F.col("x").alias("a"), F.col("y").alias("b"))))
        counts = cut_lineage(_counts(reps, links, component, k, kind, id_kind, similar))
        recall = _recall(true, counts)
        if recall >= RECALL:
            break
        k *= 2
    else:
        # The search is not known to be whole: all pairs of each label.
        counts, component = _all_pairs(reps, kind, id_kind, similar)
        recall = 1.0
    reached = reps.select("key", "copies", "id").join(counts, "id", "left").join(component, "id", "left")
    n_links = F.coalesce("n", F.lit(0)) + F.col("copies") - 1
    reached = cut_lineage(reached.select("key", "copies", n_links.cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    found = salted_join(good.select("id", "key"), reached, "key", "copies", F.col("id")).drop("key")
    alone = base.filter("key is null or id is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = found.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(float(recall)).alias("audit_recall"))


def _counts(reps: DataFrame, links: DataFrame, component: DataFrame, k: int, kind: type, id_kind: str, similar: float) -> DataFrame:
    """``id, n``: copies linked with each representative that has any link.

    A list with room holds all links found. A full one may not: its component is compared
    in blocks.
    """
    listed = links.groupBy(F.col("x").alias("id")).agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("c"))
    full = listed.filter(F.col("c") >= k).join(component, "id").select("component").distinct()
    members = component.groupBy("component").agg(F.count(F.lit(1)).alias("size")).join(full, "component")
    members = cut_lineage(members.withColumn("members", F.col("size")))
    marked = salted_join(component, members.withColumn("saturated", F.lit(True)), "component", "size", F.col("id"), "left")
    marked = cut_lineage(marked)
    # A component's blocks are in proportion to its size.
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    inside = marked.filter("saturated").join(reps.select("id", "raw", "copies"), "id").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spots = F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.array(
        F.struct(own.alias("i"), o.alias("j"), F.lit(0).alias("side")), F.struct(o.alias("i"), own.alias("j"), F.lit(1).alias("side")),
    )))
    dealt = inside.select("component", "id", "raw", "copies", F.explode(spots).alias("s"))
    dealt = dealt.select(F.concat_ws(":", F.col("component").cast("string"), F.col("s.i").cast("string"), F.col("s.j").cast("string")).alias("pair"), "id", "raw", "copies", "s.side")
    exact = dealt.repartition("pair").sortWithinPartitions("pair").mapInArrow(_count_links(kind, similar), f"id {id_kind}, n bigint")
    exact = exact.groupBy("id").agg(F.sum("n").alias("n"))
    rest = marked.filter("saturated is null").select("id")
    return listed.select("id", "n").join(rest, "id", "left_semi").unionByName(exact)


def _audit_sample(reps: DataFrame, kind: type, chance: float) -> dict[str, tuple[list, np.ndarray]]:
    """A share ``chance`` of the representatives by space, chosen by hash."""
    place = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    rows = reps.filter(place < chance).select("id", "space", "raw").collect()
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["space"], []).append(r)
    return {space: ([r["id"] for r in own], _unit([bytes(r["raw"]) for r in own], kind)) for space, own in by.items()}


def _audited(reps: DataFrame, kind: type, similar: float) -> tuple[DataFrame | None, bool]:
    """``id, true``: copies that each vector of a sample links with, and whether it is enough to judge by.

    The sample grows until ``AUDIT_LINKED`` of its vectors have a link, or it is the table.
    """
    total, width = reps.agg(F.count(F.lit(1)), F.max(F.octet_length("raw"))).first()
    most = min(AUDIT_MOST, max(AUDIT, AUDIT_BYTES // (width or 1)))
    size = AUDIT
    while True:
        true = cut_lineage(_true_links(reps, _audit_sample(reps, kind, size / max(total, 1)), kind, similar))
        if size >= total or true.filter(F.col("true") > 0).count() >= AUDIT_LINKED:
            return true, True
        if size >= most:
            return None, False
        size = min(size * 8, most)


def _true_links(reps: DataFrame, sample: dict, kind: type, similar: float) -> DataFrame:
    """``id, true``: copies that each vector of ``sample`` links with among all vectors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = np.array(batch.column(1).to_pylist(), object)
            for space in set(spaces.tolist()) & set(sample):
                part = batch.take(pa.array(np.flatnonzero(spaces == space)))
                v, copies = _unit(part.column(2).to_pylist(), kind).T, part.column(3).to_numpy()
                at = {x: k for k, x in enumerate(part.column(0).to_pylist())}
                own, asks = sample[space]
                for s in range(0, len(own), BLOCK):
                    linked = asks[s : s + BLOCK] @ v >= similar
                    for i, x in enumerate(own[s : s + BLOCK]):
                        if x in at:
                            linked[i, at[x]] = False
                    n = linked @ copies
                    yield pa.RecordBatch.from_arrays([pa.array(own[s : s + BLOCK], batch.column(0).type), pa.array(n, pa.int64())], names=["id", "true"])

    kind_of_id = reps.schema["id"].dataType.simpleString()
    return reps.select("id", "space", "raw", "copies").mapInArrow(count, f"id {kind_of_id}, true bigint").groupBy("id").agg(F.sum("true").alias("true"))


def _recall(true: DataFrame, counts: DataFrame) -> float:
    """Share of the audited links that were found: of all, or the mean over vectors if that is less."""
    hit = F.least(F.coalesce("n", F.lit(0)), "true")
    row = true.filter(F.col("true") > 0).join(counts, "id", "left").agg(F.sum("true"), F.sum(hit), F.avg(hit / F.col("true"))).first()
    return min(row[1] / row[0], row[2]) if row[0] else 1.0


def _all_pairs(reps: DataFrame, kind: type, id_kind: str, similar: float) -> tuple[DataFrame, DataFrame]:
    """``id, n`` and ``id, component`` from all pairs of each space, block by block."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches):
            block, ids, copies = table["block"].to_numpy(), table["id"].to_pylist(), table["copies"].to_numpy()
            v = _unit(table["raw"].to_pylist(), kind)
            one, other = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
            alone = table["alone"][0].as_py()
            if not alone and block.min() == block.max():
                continue  # the other block is empty
            linked = v[one] @ v[other].T >= similar
            if alone:
                np.fill_diagonal(linked, False)
            n = np.zeros(len(ids), np.int64)
            n[one] = linked @ copies[other]
            if not alone:
                n[other] = copies[one] @ linked
            groups, a, b = Groups(), [], []
            for x, y in zip(*(k.tolist() for k in np.nonzero(linked))):
                if groups.join(ids[one[x]], ids[other[y]]):
                    a.append(ids[one[x]])
                    b.append(ids[other[y]])
            at = np.flatnonzero(n)
            type_ = table.schema.field("id").type
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[k] for k in at.tolist()] + a, type_), pa.array([None] * len(at) + b, type_), pa.array(n[at].tolist() + [0] * len(a), pa.int64())], names=["id", "other", "n"]
            )

    blocks = F.ceil(F.col("size") / ALL_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = reps.withColumn("blocks", blocks).withColumn("block", own)
    met = rows.select("space", "id", "raw", "copies", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    pair = F.concat_ws(":", "space", F.least("block", "o").cast("string"), F.greatest("block", "o").cast("string"))
    met = met.select(pair.alias("pair"), "id", "raw", "copies", "block", (F.col("block") == F.col("o")).alias("alone"))
    out = cut_lineage(met.repartition("pair").sortWithinPartitions("pair").mapInArrow(compare, f"id {id_kind}, other {id_kind}, n bigint"))
    counts = cut_lineage(out.filter("other is null").groupBy("id").agg(F.sum("n").alias("n")))
    component = cut_lineage(connected(out.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))))
    return counts, component
