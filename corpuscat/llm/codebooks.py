"""Vector codes from codebooks that Ball k-means trains in whole numbers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpuscat.operators.scale import lookup
from corpuscat.session import cut_lineage, drop_path, scratch_path, store

PARTS, ENTRIES, ROUNDS = 8, 16, 6
STEP = 4_096  # whole steps in a component of 1
BLOCK, BLOCK_BYTES = 4_096, 4 << 20  # vectors that travel and are assigned together, at most
STATE = "block bigint, ids binary, labels binary, whole binary, codes binary, far array<bigint>, counts array<bigint>, sums array<bigint>, compared bigint"


def limit(width: int) -> int:
    """The largest component, in steps, whose squared distances stay within 64 bits even four times over."""
    return math.isqrt((1 << 60) // max(width, 1)) // 2


def _packed(array: pa.Array) -> bytes:
    """A column as bytes, of whatever type."""
    batch = pa.RecordBatch.from_arrays([array], names=["c"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pa.Array:
    with pa.ipc.open_stream(raw) as reader:
        return reader.read_all().column(0).combine_chunks()


def _whole(kind: type, width: int, parts: int):
    """Blocks of vectors as whole numbers, all at entry 0 for a start."""
    rows = max(1, min(BLOCK, BLOCK_BYTES // (4 * width)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, rows):
                part = batch.slice(s, rows)
                whole = _steps(part.column(2).to_pylist(), kind).astype(np.int32)  # ``limit`` is less
                yield _row(_packed(part.column(0)), _packed(part.column(1)), whole.tobytes(), np.zeros((part.num_rows, parts), np.uint8), None)

    return pack


def _steps(raws: list[bytes], kind: type) -> np.ndarray:
    v = np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(np.float64)
    return np.floor(v * STEP)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Each block's row, its vectors and its codes; one block at a time leaves Arrow."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            yield r, np.frombuffer(r["whole"], np.int32).astype(np.int64).reshape(-1, width), np.frombuffer(r["codes"], np.uint8).reshape(-1, parts)


def _row(ids: bytes, labels: bytes, whole: bytes, codes: np.ndarray, found: dict | None) -> pa.RecordBatch:
    lists = [pa.array([None if found is None else found[k].ravel().tolist()], pa.list_(pa.int64())) for k in ("far", "counts", "sums")]
    ends = [pa.array([len(codes)], pa.int64()), *(pa.array([b], pa.binary()) for b in (ids, labels, whole, codes.tobytes())), *lists]
    ends.append(pa.array([0 if found is None else found["compared"]], pa.int64()))
    return pa.RecordBatch.from_arrays(ends, names=["block", "ids", "labels", "whole", "codes", "far", "counts", "sums", "compared"])


class Books:
    """Codebooks of all parts, with each entry's others by rising distance.

    ``entries`` is parts x entries x positions in whole numbers; ``moved`` says which
    entries the last update changed.
    """

    def __init__(self, entries: np.ndarray, moved: np.ndarray):
        self.entries, self.moved = entries, moved
        gaps = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(axis=3)
        self.order = np.argsort(gaps, axis=2, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=2)


def assign(whole: np.ndarray, codes: np.ndarray, far: np.ndarray | None, books: Books) -> tuple[np.ndarray, np.ndarray, int]:
    """``codes, far, compared``: nearest entries of a block of vectors, ties to the lower index.

    The members of an entry are a ball of squared radius ``far``. Another entry can win a
    member at squared distance ``d`` from its own only if the squared gap of both entries is
    at most ``4 d`` (the triangle inequality; a gap of just that may tie). So

    * an entry that did not move, and has no moved entry within the gap that its radius
      allows, keeps all its members without a look at them;
    * of other balls each member's own distance is computed, and those below the first
      gap's quarter, the stable core, stay;
    * the rest lies in rings between the quarters of one gap and the next, and a ring is
      compared with the neighbours of smaller gaps alone.

    All is in whole numbers, so the result is that of comparing with every entry.
    ``compared`` is the number of distances computed.
    """
    n, parts = codes.shape
    entries = books.entries
    k = entries.shape[1]
    x = whole.reshape(n, parts, -1)
    out, radius = codes.copy(), np.full((parts, k), -1, np.int64)
    compared = 0
    for p in range(parts):
        for e in np.unique(codes[:, p]).tolist():
            at = np.flatnonzero(codes[:, p] == e)
            near, gaps = books.order[p, e], books.gaps[p, e]
            others = near != e
            near, gaps = near[others], gaps[others]
            if far is not None and not books.moved[p, e] and not books.moved[p, near[gaps <= 4 * far[p, e]]].any():
                radius[p, e] = max(radius[p, e], far[p, e])
                continue
            v = x[at, p]
            best = ((v - entries[p, e]) ** 2).sum(axis=1)
            compared += len(at)
            reach = np.searchsorted(gaps, 4 * best, side="right")  # neighbours that a member may be nearer to
            winner = np.full(len(at), e)
            least = best.copy()
            for j in range(int(reach.max(initial=0))):
                ring = np.flatnonzero(reach > j)
                d = ((v[ring] - entries[p, near[j]]) ** 2).sum(axis=1)
                compared += len(ring)
                better = (d < least[ring]) | ((d == least[ring]) & (near[j] < winner[ring]))
                ring = ring[better]
                least[ring], winner[ring] = d[better], near[j]
            out[at, p] = winner
            np.maximum.at(radius[p], winner, least)
    return out, radius, compared


def _sums(whole: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n, parts = codes.shape
    x = whole.reshape(n, parts, -1)
    counts = np.zeros((parts, k), np.int64)
    sums = np.zeros((parts, k, x.shape[2]), np.int64)
    for p in range(parts):
        counts[p] = np.bincount(codes[:, p], minlength=k)
        np.add.at(sums[p], codes[:, p], x[:, p])
    return counts, sums


def _assigned(books: Books, width: int, parts: int):
    """One round of a block: new codes, radii of its balls, and sums for the next entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, whole, codes in _blocks(batches, width, parts):
            far = None if r["far"] is None else np.array(r["far"]).reshape(parts, -1)
            codes, radius, compared = assign(whole, codes, far, books)
            counts, sums = _sums(whole, codes, books.entries.shape[1])
            yield _row(r["ids"], r["labels"], r["whole"], codes, {"far": radius, "counts": counts, "sums": sums, "compared": compared})

    return run


def _errors(books: Books, width: int, parts: int, digest: str, id_type: pa.DataType, label_type: pa.DataType):
    """Blocks as rows: each vector's code and its squared distance from the coded vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, whole, codes in _blocks(batches, width, parts):
            coded = books.entries[np.arange(parts)[None, :], codes]
            error = ((whole.reshape(coded.shape) - coded) ** 2).sum(axis=(1, 2))
            ids, labels = _unpacked(r["ids"]).cast(id_type), _unpacked(r["labels"]).cast(label_type)
            text = pa.array([c.tobytes().hex() for c in codes])
            yield pa.RecordBatch.from_arrays([ids, labels, text, pa.array(error, pa.int64()), pa.array([digest] * len(codes))], names=["id", "label", "code", "error", "digest"])

    return run


def _update(state: DataFrame, books: Books) -> Books:
    """Entries at the floor of their members' mean; unused ones stay.

    The blocks' sums are summed by place in the codebook, so the driver gets one number for
    each position of each entry, however many vectors there are.
    """
    parts, k, length = books.entries.shape
    total = lambda c: state.select(F.posexplode(c).alias("at", "n")).groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    counts = {r["at"]: int(r["n"]) for r in total("counts")}
    sums = {r["at"]: int(r["n"]) for r in total("sums")}
    new = books.entries.copy().reshape(parts * k, length)
    for e, n in counts.items():
        if n:
            new[e] = [sums[e * length + j] // n for j in range(length)]
    new = new.reshape(parts, k, length)
    return Books(new, (new != books.entries).any(axis=2))


def _usable(kind: type, parts: int):
    """Vectors as bytes, null for those with a null or non-finite component, and whether they can be coded."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, sound = [], []
            for v in batch.column(2).to_pylist():
                a = None if v is None or None in v else np.array(v, kind)
                a = None if a is None or not np.isfinite(a).all() else a
                raws.append(None if a is None else a.tobytes())
                cut = a is not None and len(a) > 0 and len(a) % parts == 0
                with np.errstate(over="ignore"):
                    sound.append(cut and bool(np.abs(np.floor(a.astype(np.float64) * STEP)).max() <= limit(len(a))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raws, pa.binary()), pa.array(sound)], names=["id", "label", "raw", "sound"])

    return read


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, stats: list | None = None,
) -> DataFrame:
    """``id_col, label_col, code, error, codebooks_sha256``: one row for each usable vector.

    Components become ``floor(4096 x)``. Vectors are cut into ``parts`` equal pieces, each
    with a codebook of at most 256 ``entries`` that starts as the pieces of the vectors of
    the smallest ids (fewer entries if there are fewer vectors; rows of one id by their
    bytes). Each of ``rounds`` rounds assigns every piece to its nearest entry, ties to the
    lower index, and moves each used entry to the floor of its members' mean; then pieces
    are assigned again. Everything is in whole numbers and equals the plain method;
    ``assign`` says which comparisons Ball k-means leaves out.

    Vectors travel in blocks with their codes and the radii of their balls. A round reads
    and writes the stored blocks, so a lost executor costs its own blocks of one round; the
    round before is dropped. Only the codebooks go to tasks, and only one number for each
    of their positions to the driver: both depend on the width alone.

    Rows whose vector is null or holds null or non-finite components are dropped. A null id
    sorts last and stays; repeated rows are vectors each. A vector keeps its row with a null
    code and error if its length is not that of the first one, or not a positive multiple of
    ``parts``, or if a component is beyond ``limit``, so that squared distances would leave 64
    bits. An empty table gives an empty result; other columns are not read. ``stats``, a
    list, gets the number of distances computed in each round.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    spark = vectors.sparkSession
    kind = np.float32 if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else np.float64
    id_field, label_field = vectors.schema[id_col].dataType, vectors.schema[label_col].dataType
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").alias("v"))
    good = rows.mapInArrow(_usable(kind, parts), f"id {id_field.simpleString()}, label {label_field.simpleString()}, raw binary, sound boolean").filter("raw is not null")
    good = cut_lineage(good)
    order = [F.col("id").asc_nulls_last(), F.col("raw")]
    first = good.filter("sound").orderBy(*order).limit(1).collect()
    named = [F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", F.col("digest").alias("codebooks_sha256")]

    def without_code(df: DataFrame, digest: str | None) -> DataFrame:
        return df.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"), F.lit(digest).cast("string").alias("digest"))

    if not first:
        return without_code(good, None).select(*named)
    size = len(first[0]["raw"])
    width = size // np.dtype(kind).itemsize
    fits = F.col("sound") & (F.octet_length("raw") == size)
    starts = good.filter(fits).orderBy(*order).limit(entries).collect()
    start = _steps([bytes(r["raw"]) for r in starts], kind).astype(np.int64).reshape(len(starts), parts, -1).transpose(1, 0, 2)
    books = Books(np.ascontiguousarray(start), np.ones((parts, len(starts)), bool))

    state, path = good.filter(fits).mapInArrow(_whole(kind, width, parts), STATE), None
    for r in range(rounds + 1):
        before, path = path, scratch_path(spark, "blocks")
        state = store(state.mapInArrow(_assigned(books, width, parts), STATE), path)
        if before:
            drop_path(spark, before)
        if stats is not None:
            stats.append(state.agg(F.sum("compared")).first()[0])
        if r < rounds:
            books = _update(state, books)
    digest = hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()
    coded = state.mapInArrow(
        _errors(books, width, parts, digest, to_arrow_type(id_field), to_arrow_type(label_field)),
        f"id {id_field.simpleString()}, label {label_field.simpleString()}, code string, error bigint, digest string",
    )
    return coded.unionByName(without_code(good.filter(~fits), digest)).select(*named)


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` with ``label_error``, the sum of ``error`` over the rows of its label; nulls are one label.

    Sums combine before their shuffle, and a label that most rows have is dealt over many
    tasks where the labels are too many to broadcast.
    """
    key = F.concat_ws(":", F.when(F.col(label_col).isNull(), "none").otherwise("some"), F.col(label_col).cast("string"))
    stored = cut_lineage(coded.withColumn("_label_key", key))
    sums = cut_lineage(stored.groupBy("_label_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"), F.count(F.lit(1)).alias("_n")))
    found = lookup(stored, sums, "_label_key", "_n", "left", complete=True)
    return found.drop("_label_key").withColumn("label_error", F.col("label_error").cast("bigint"))
