"""Near copies by probability min-wise hashing of shingles, banding and verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscat.llm.batches import runs, slices
from corpuscat.llm.links import Groups, connected
from corpuscat.operators.scale import salted_join
from corpuscat.session import cut_lineage

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
# Signatures of texts as similar as SIMILAR agree in fewer registers once in 10,000 pairs.
LIKELY = 0.65
BUCKET = 256  # larger buckets make one family without a look at signatures
BLOCK_TEXTS, BLOCK_SHINGLES = 128, 1 << 18  # of a family that one task compares
SLICE_BYTES = 2 << 20

# An odd multiplier with its inverse mod 2^64, and the mixer's constants.
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K = np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = np.zeros(256, np.uint64)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _WORD[_b] = ord(chr(_b).lower()) + 1 if _b < 128 else _b + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all ``texts``, and the text it is in.

    A word is a run of ASCII letters and digits, in lower case, and characters beyond ASCII.
    """
    data = [t.encode(errors="replace") + b" " for t in texts]
    if not data:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    b = _WORD[np.frombuffer(b"".join(data), np.uint8)]
    n = len(b)
    power = np.full(n, _P, np.uint64)
    power[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * np.cumprod(power))])
    power[1:] = _P_INVERSE
    inverse = np.cumprod(power)
    inside = np.concatenate([[False], b > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    begins = np.cumsum([0, *[len(d) for d in data][:-1]])
    return _mix((sums[end] - sums[start]) * inverse[start]), np.searchsorted(begins, start, "right") - 1


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of all texts the distinct shingles: text, hash and count; and a digest of each text's words.

    A text of one to four words has one shingle, all its words.
    """
    words, owner = word_hashes(texts)
    n = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(n)
    digests = [hashlib.blake2b(words[e - k : e].tobytes(), digest_size=16).digest() if k else b"" for k, e in zip(n.tolist(), ends.tolist())]
    m = max(len(words) - WORDS + 1, 0)
    h = np.zeros(m, np.uint64)
    for k in range(WORDS):
        h = h * _K + words[k : k + m]
    whole = owner[:m] == owner[WORDS - 1 : WORDS - 1 + m]
    found, texts_of = [_mix(h[whole])], [owner[:m][whole]]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        total = np.array([int(np.bitwise_xor.reduce(_mix(words[ends[i] - n[i] : ends[i]] + np.arange(n[i], dtype=np.uint64)))) for i in short.tolist()], np.uint64)
        found.append(_mix(total + np.uint64(1)))
        texts_of.append(short)
    h, d = np.concatenate(found), np.concatenate(texts_of)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(h))), digests


def signatures(n_texts: int, text: np.ndarray, element: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Min-wise registers of weighted elements: two texts agree in one with their probability Jaccard.

    Each element sends arrivals of a Poisson process at the rate of its weight, each to a
    register drawn by hash; a register keeps the element that arrives first. An element
    stops once its next arrival is later than the latest first arrival of its text.
    """
    first = np.full(n_texts * REGISTERS, np.inf)
    kept = np.zeros(n_texts * REGISTERS, np.uint64)
    time, wave = np.zeros(len(element)), 0
    live = np.arange(len(element))
    while len(live):
        many = 1 if len(live) > 8_192 else 16
        no = np.arange(wave, wave + many, dtype=np.uint64)
        draw = _mix(element[live][:, None] + (no * _P)[None, :])
        gap = -np.log((np.float64(1.0) + (draw >> np.uint64(11))) * 2.0**-53)
        when = time[live][:, None] + np.cumsum(gap / weight[live][:, None], axis=1)
        register = (_mix(draw ^ _K) % np.uint64(REGISTERS)).astype(np.int64)
        slot = (text[live][:, None] * REGISTERS + register).ravel()
        flat, what = when.ravel(), np.repeat(element[live], many)
        better = flat < first[slot]
        slot, flat, what = slot[better], flat[better], what[better]
        order = np.lexsort((what, flat, slot))
        slot, flat, what = slot[order], flat[order], what[order]
        lead = np.ones(len(slot), bool)
        lead[1:] = slot[1:] != slot[:-1]
        first[slot[lead]], kept[slot[lead]] = flat[lead], what[lead]
        time[live] = when[:, -1]
        wave += many
        latest = first.reshape(n_texts, REGISTERS).max(axis=1)
        live = live[time[live] < latest[text[live]]]
    return kept.reshape(n_texts, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One bucket key for each band of each text."""
    r = registers.reshape(len(registers), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * _P
    for k in range(ROWS):
        key = _mix(key * _K + r[:, :, k])
    return key.view(np.int64)


def level(count: np.ndarray) -> np.ndarray:
    """Weight of a shingle that occurs ``count`` times: 1, and 1 more for each doubling."""
    return np.frexp(count.astype(np.float64))[1]


def _low(registers: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in (_mix(registers) & np.uint64(255)).astype(np.uint8)], pa.binary())


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end in slices(batch.column(1), SLICE_BYTES):
            texts = batch.column(1).slice(start, end - start).to_pylist()
            d, h, count, digests = shingles(texts)
            plain = signatures(len(texts), d, h, np.ones(len(h)))
            # Where no shingle repeats, all weights are 1 and both signatures are one.
            repeats = np.bincount(d[count > 1], minlength=len(texts)) > 0
            again, place = np.flatnonzero(repeats), np.cumsum(repeats) - 1
            weighted, own = plain.copy(), repeats[d]
            weighted[again] = signatures(len(again), place[d[own]], h[own], level(count[own]))
            n = np.bincount(d, minlength=len(texts))
            keys, others = band_keys(plain), band_keys(weighted)
            each = [np.union1d(k, o) if r else k for k, o, r in zip(keys, others, repeats.tolist())]
            ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(ends, np.concatenate(each) if each else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, end - start), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), bands, _low(plain), _low(weighted)],
                names=["id", "digest", "n", "bands", "low", "low_weighted"],
            )


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that span, in each bucket, all pairs whose signatures agree enough."""
    for table in runs(batches, 0, 20_000):
        bucket, rep = table["bucket"].to_numpy(), table["rep"].to_pylist()
        lows = [np.frombuffer(b"".join(table[c].to_pylist()), np.uint8).reshape(len(rep), REGISTERS) for c in ("low", "low_weighted")]
        groups, a, b = Groups(), [], []
        apart = 1
        while apart < len(rep):
            i = np.flatnonzero(bucket[apart:] == bucket[:-apart])
            if not len(i):
                break
            for s in range(0, len(i), 4_096):
                part = i[s : s + 4_096]
                agree = np.maximum(*[(low[part] == low[part + apart]).sum(axis=1) for low in lows])
                good = part[agree >= LIKELY * REGISTERS]
                for k in good.tolist():
                    if groups.join(rep[k], rep[k + apart]):
                        a.append(rep[k])
                        b.append(rep[k + apart])
            apart += 1
        yield pa.RecordBatch.from_arrays([pa.array(a, table.schema.field("rep").type), pa.array(b, table.schema.field("rep").type)], names=["a", "b"])


def _shared(n_texts: int, text: np.ndarray, element: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of distinct elements that each of ``left`` shares with each of ``right``."""
    _, column, times = np.unique(element, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # what only one text has joins no pair
    d, column = text[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((len(left), len(right)))
    step = 8_192
    order = np.argsort(column, kind="stable")
    d, column = d[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for s in range(0, width, step):
        lo, hi = np.searchsorted(column, [s, s + step])
        m = np.zeros((n_texts, min(step, width - s)), np.float32)
        m[d[lo:hi], column[lo:hi] - s] = 1
        both += m[left] @ m[right].T
    return both


def compare(texts: list[str], left: np.ndarray, right: np.ndarray, similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (left, right) of texts, by place, whose shingles have a Jaccard similarity >= ``similar``.

    That of the distinct shingles, or that of the shingles weighted by ``level``: the sum of
    the smaller weights over the sum of the larger ones.
    """
    d, h, count, _ = shingles(texts)
    n = np.bincount(d, minlength=len(texts)).astype(np.float64)
    both = _shared(len(texts), d, h, left, right)
    # A shingle of weight w is w elements, so that the smaller weight is what two texts share.
    more = level(count) - 1
    times = np.repeat(np.arange(len(h)), more)
    nth = (np.arange(len(times)) - np.repeat(np.cumsum(more) - more, more) + 1).astype(np.uint64)
    extra = _shared(len(texts), d[times], _mix(h[times] + nth * _P), left, right)
    heavy = np.bincount(d[times], minlength=len(texts))

    def alike(shared: np.ndarray, size: np.ndarray) -> np.ndarray:
        union = size[left][:, None] + size[right][None, :] - shared
        return (shared >= similar * union - 1e-9) & (union > 0)

    i, j = np.nonzero(alike(both, n) | alike(both + extra, n + heavy))
    return left[i], right[j]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that span all similar pairs of each group: ``key, rep, side, text``.

    Side 0 is compared with all, sides 1 and 2 only with side 0; texts of side 2 are of one
    class already.
    """
    for table in runs(batches):
        rep, side = table["rep"].to_pylist(), table["side"].to_numpy()
        left = np.flatnonzero(side == 0)
        a, b = compare(table["text"].to_pylist(), left, np.arange(len(rep)))
        groups, out_a, out_b = Groups(), [], []
        known = np.flatnonzero(side == 2).tolist()
        for k in known[1:]:
            groups.join(rep[known[0]], rep[k])
        for x, y in zip(a.tolist(), b.tolist()):
            if x != y and groups.join(rep[x], rep[y]):
                out_a.append(rep[x])
                out_b.append(rep[y])
        kind = table.schema.field("rep").type
        yield pa.RecordBatch.from_arrays([pa.array(out_a, kind), pa.array(out_b, kind)], names=["a", "b"])


def _beside_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``family, rep, text`` with ``near``: whether the text is similar to its pivot's."""
    for batch in batches:
        for start, end in slices(batch.column(2), SLICE_BYTES):
            part = batch.slice(start, end - start)
            texts, pivots = part.column(2).to_pylist(), part.column(3).to_pylist()
            near = np.zeros(len(texts), bool)
            by_pivot: dict[str, list[int]] = {}
            for i, p in enumerate(pivots):
                by_pivot.setdefault(p, []).append(i)
            for p, rows in by_pivot.items():
                got, _ = compare([*[texts[i] for i in rows], p], np.arange(len(rows)), np.array([len(rows)]))
                near[np.array(rows)[got]] = True
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(near)], names=["family", "rep", "text", "near"])


def _families(reps: DataFrame, kind: str) -> DataFrame:
    """``id, component``: representatives that may be similar, in families closed under likely pairs.

    Families only say what is compared with what, so a wider one costs time and loses
    nothing. In buckets up to ``BUCKET`` texts, pairs with unlike signatures are left out;
    in larger ones all texts join the smallest.
    """
    keyed = reps.select("rep", F.explode("bands").alias("bucket"))
    buckets = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).filter("n > 1")
    buckets = cut_lineage(buckets.withColumn("size", F.col("n")))
    placed = cut_lineage(salted_join(keyed, buckets, "bucket", "n", F.col("rep")))
    small = placed.filter(F.col("size") <= BUCKET).select("bucket", "rep").join(reps.select("rep", "low", "low_weighted"), "rep")
    likely = small.select("bucket", "rep", "low", "low_weighted").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_likely, f"a {kind}, b {kind}")
    wide = placed.filter(F.col("size") > BUCKET).select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    return cut_lineage(connected(likely.unionByName(wide)))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, class_id, kept``; the class is its smallest id.

    Texts are linked when the Jaccard similarity of their five-word shingles is at least
    ``SIMILAR``, either that of distinct shingles or that of shingles weighted by how often
    they occur (``level``); a class is all that links reach. Texts with the same words are
    one representative. It has a signature for each: with all weights 1, where registers
    agree by the set similarity, and with its weights, where they agree by the probability
    Jaccard; without repeated shingles both are one. So near copies meet that differ in how
    often a line repeats, and those that differ in what is said once beside lines that
    repeat. Bands of both gather candidates into families, and
    within a family the whole texts are compared: in one task if the family is small, else
    first with its smallest id, then what that leaves in blocks against all. Tasks return
    spanning links, so no group is written out in pairs, and no link within a family is lost.

    Null texts and texts without a word are alone, as are rows with null ids (class null,
    kept). Rows that repeat an id share a class. Empty tables give empty results; other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text"))
    base = cut_lineage(rows.mapInArrow(_sketch, f"id {kind}, digest binary, n bigint, bands array<bigint>, low binary, low_weighted binary"))
    worded = base.filter("n > 0 and id is not null")
    reps = cut_lineage(worded.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                                    *[F.first(c).alias(c) for c in ("n", "bands", "low", "low_weighted")]))
    family = _families(reps, kind)
    # Sizes decide how many blocks a family is cut into.
    sized = family.join(reps.select(F.col("rep").alias("id"), "n"), "id")
    totals = sized.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    totals = cut_lineage(totals.select("component", "members", blocks.alias("blocks")))
    known = salted_join(family, totals, "component", "members", F.col("id"))
    texts = cut_lineage(rows.join(known, "id").select(F.col("component").alias("family"), F.col("id").alias("rep"), "text", "blocks"))
    links = _few(texts.filter("blocks = 1"), kind).unionByName(_many(texts.filter("blocks > 1"), totals, kind))
    classes = cut_lineage(connected(cut_lineage(links)))
    reached = reps.select("rep", "digest", "copies").join(classes.withColumnRenamed("id", "rep"), "rep", "left")
    reached = cut_lineage(reached.select("digest", "copies", F.coalesce("component", "rep").alias("class_id")))
    found = salted_join(worded.select("id", "digest"), reached, "digest", "copies", F.col("id")).select("id", "class_id")
    alone = base.filter("n = 0 or id is null").select("id", F.col("id").alias("class_id"))
    out = found.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def _few(texts: DataFrame, kind: str) -> DataFrame:
    """Links within families that one task can compare."""
    grouped = texts.select(F.col("family").alias("key"), "rep", F.lit(0).alias("side"), "text")
    return grouped.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, f"a {kind}, b {kind}")


def _many(texts: DataFrame, totals: DataFrame, kind: str) -> DataFrame:
    """Links within larger families: first to the smallest id, then block by block."""
    pivots = texts.filter("rep = family").groupBy("family").agg(F.first("text").alias("pivot"))
    pivots = cut_lineage(pivots.join(totals.select(F.col("component").alias("family"), "members"), "family"))
    beside = salted_join(texts.select("family", "rep", "text"), pivots, "family", "members", F.col("rep"))
    beside = cut_lineage(beside.mapInArrow(_beside_pivot, f"family {kind}, rep {kind}, text string, near boolean"))
    to_pivot = beside.filter("near and rep <> family").select(F.col("rep").alias("a"), F.col("family").alias("b"))
    # What is not near the pivot is cut into blocks, and each meets every block of the family.
    rest = beside.groupBy("family").agg(F.count(F.when(~F.col("near"), 1)).alias("rest"), F.count(F.lit(1)).alias("n"))
    rest = rest.join(totals.select(F.col("component").alias("family"), "members", "blocks"), "family")
    rest = cut_lineage(rest.filter("rest > 0").select("family", "n", "blocks", F.ceil(F.col("rest") * F.col("blocks") / F.col("members")).cast("int").alias("rest_blocks")))
    dealt = salted_join(beside, rest, "family", "n", F.col("rep"))
    place = F.xxhash64("rep")
    one, other = F.pmod(place, F.col("rest_blocks")).cast("int"), F.pmod(place, F.col("blocks")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # A text of the rest leads its block against each block of the near, and meets the rest's blocks.
    spots = F.when(
        F.col("near"), F.transform(upto(F.col("rest_blocks")), lambda i: F.struct(i.alias("i"), F.lit(1).alias("with"), other.alias("j"), F.lit(2).alias("side")))
    ).otherwise(
        F.concat(
            F.transform(upto(F.col("blocks")), lambda j: F.struct(one.alias("i"), F.lit(1).alias("with"), j.alias("j"), F.lit(0).alias("side"))),
            F.transform(upto(F.col("rest_blocks")), lambda j: F.struct(F.least(one, j).alias("i"), F.lit(0).alias("with"), F.greatest(one, j).alias("j"), F.when(one <= j, 0).otherwise(1).alias("side"))),
        )
    )
    spread = dealt.select("family", "rep", "text", F.explode(spots).alias("s")).select(
        F.concat_ws(":", "family", "s.with", "s.i", "s.j").alias("key"), "rep", F.col("s.side").alias("side"), "text"
    )
    links = spread.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, f"a {kind}, b {kind}")
    return links.unionByName(to_pivot)


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class, or null.

    Rows without an id cannot be named and stay, as do null texts and texts without a word,
    which are alone. Rows that repeat a kept id stay as often as they are there. An empty table
    gives an empty result, and columns may have any names.
    """
    name = "_near_id"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    dropped = near_classes(docs, id_col, text_col).filter("not kept").select(F.col(f"`{id_col}`").alias(name)).distinct()
    return docs.join(dropped, F.col(f"`{id_col}`") == F.col(name), "left_anti")
