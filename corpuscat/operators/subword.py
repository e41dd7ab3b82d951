"""Sub-word encoding with a given vocabulary, greedy longest match as joins.

The vocabulary is a table of any size. Python only strips the accents of each distinct word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscat.operators.scale import BROADCAST_BYTES, lookup, rank_all, spread
from corpuscat.operators.tokens import FIRST_ID, UNK, padded
from corpuscat.session import cut_lineage

# Fixed values of the published WordPiece scheme.
UNKNOWN, CONTINUED, LONGEST_WORD = "[UNK]", "##", 100
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
MARKS = r"\p{P}$+<=>^`|~"  # each punctuation mark, and each CJK sign, is a word of its own
WORD = rf"[{MARKS}{CJK}]|[^\s\p{{Z}}\p{{C}}{MARKS}{CJK}]+"
# Of these, words that are more than accents.
BASED = rf"[{MARKS}{CJK}]|\p{{Mn}}*+[^\s\p{{Z}}\p{{C}}\p{{Mn}}{MARKS}{CJK}][^\s\p{{Z}}\p{{C}}{MARKS}{CJK}]*+"


def basic_words(text: Column, word: str = WORD) -> Column:
    """Lower-case words, punctuation marks and CJK signs of a raw text."""
    dropped = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x{FFFD}[\p{C}&&[^\t\n\r]]]", "")
    return F.regexp_extract_all(F.lower(dropped), F.lit(word), F.lit(0))


def without_accents(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")


def _bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bare = [w if w.isascii() else without_accents(w) for w in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bare, pa.string())], names=[*batch.schema.names, "bare"])


def with_bare(words: DataFrame) -> DataFrame:
    """``words(token, n)`` with ``bare``, the token without its accents."""
    # Python work per word is costly for its bytes: keep all shuffle partitions.
    words = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token")
    return words.mapInArrow(_bare, "token string, n bigint, bare string")


def corpus_pieces(df: DataFrame, text: str, min_count: int = 5) -> DataFrame:
    """``(piece, id)``: a vocabulary of every character and every word that occurs ``min_count`` times.

    Both stand as starts and, marked, as inner pieces, without accents; ids follow the order
    of the pieces after the special ones, and the unknown piece is there.
    """
    each = df.select(F.explode(basic_words(F.col(text))).alias("token"))
    words = cut_lineage(with_bare(each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))))
    characters = words.select(F.explode(F.split("bare", "")).alias("s"))
    whole = words.filter(F.col("n") >= min_count).select(F.col("bare").alias("s"))
    bare = characters.unionByName(whole).filter("s <> ''").distinct()
    pieces = bare.select(F.explode(F.array(F.col("s"), F.concat(F.lit(CONTINUED), "s"))).alias("piece"))
    ranked = rank_all(pieces, [F.col("piece")], "id", FIRST_ID).select("piece", F.col("id").cast("int").alias("id"))
    unknown = df.sparkSession.createDataFrame([(UNKNOWN, UNK)], "piece string, id int")
    return ranked.unionByName(unknown)


def split_words(words: DataFrame, pieces: DataFrame, unknown: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``words(token, n, bare)`` as ``(token, n, ids)`` by greedy longest match with ``pieces(piece, id)``.

    Every part of a word that is as long as some piece is a candidate. Candidates are counted
    by their text before they meet the partitioned pieces, so a single letter that all words
    have is one row there; what is found goes back to the words through ``lookup``, which
    deals frequent parts over many tasks. The longest piece from each place is a step, and the
    steps from place to place spell the word. A word that no steps span, or that is longer than
    ``LONGEST_WORD``, has the unknown id; one of accents alone has none.
    """
    inner = F.col("piece").startswith(CONTINUED)
    text = F.when(inner, F.substring("piece", len(CONTINUED) + 1, 1_000_000)).otherwise(F.col("piece"))
    table = pieces.select(F.concat(F.when(inner, F.lit("+")).otherwise(F.lit("-")), text).alias("part"), F.col("id").cast("int").alias("id"), F.length(text).alias("size"))
    table = table.filter(F.col("size").between(1, LONGEST_WORD))
    # Lengths of pieces: at most LONGEST_WORD numbers.
    sizes = sorted(r[0] for r in table.select("size").distinct().collect())
    place, rest = F.col("place"), F.length("bare") - F.col("place")
    spelled = words.filter(F.length("bare").between(1, LONGEST_WORD))
    each = spelled.select("token", "bare", F.explode(F.sequence(F.lit(0), F.length("bare") - 1)).alias("place"))
    each = each.select("token", "bare", "place", F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]).cast("array<int>"), lambda s: s <= rest)).alias("size"))
    mark = F.when(place > 0, F.lit("+")).otherwise(F.lit("-"))
    each = cut_lineage(each.select("token", "place", "size", F.concat(mark, F.substr("bare", place + 1, F.col("size"))).alias("part")))
    counted = each.groupBy("part").agg(F.count(F.lit(1)).alias("uses"))
    known = cut_lineage(counted.join(table.select("part", "id"), "part"))
    found = lookup(each, known, "part", "uses", max_bytes=max_bytes)
    steps = found.groupBy("token", "place").agg(F.max(F.struct("size", "id")).alias("step"))
    # A word has at most LONGEST_WORD places.
    maps = steps.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("place", "step"))).alias("steps"))

    def walk(at: Column, _: Column) -> Column:
        step = F.try_element_at(F.col("steps"), at["place"])
        taken = F.struct((at["place"] + step["size"]).alias("place"), F.concat(at["ids"], F.array(step["id"])).alias("ids"))
        return F.when(step.isNull() | (at["place"] >= F.length("bare")), at).otherwise(taken)

    start = F.struct(F.lit(0).alias("place"), F.array().cast("array<int>").alias("ids"))
    joined = words.join(maps, "token", "left")
    walked = joined.withColumn("end", F.aggregate(F.sequence(F.lit(1), F.greatest(F.length("bare"), F.lit(1))), start, walk))
    ids = F.when(F.length("bare") == 0, F.array().cast("array<int>")).when(F.col("steps").isNotNull() & (F.col("end.place") == F.length("bare")), F.col("end.ids"))
    return walked.select("token", "n", F.coalesce(ids, F.array(F.lit(unknown))).alias("ids"))


def subword_encode(df: DataFrame, row_id: str, text: str, pieces: DataFrame, length: int = 512, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(row_id, input_ids, attention_mask)``; ``pieces(piece, id)`` holds at least ``[UNK]``.

    The special ids of the result are those of ``corpuscat.operators.tokens``. Texts are raw:
    punctuation marks are words of their own. The vocabulary may have any size.
    """
    unknown = pieces.filter(F.col("piece") == UNKNOWN).first()
    if unknown is None:
        raise ValueError(f"the vocabulary lacks {UNKNOWN}")
    # A word gives one piece at least, unless it is all accents, so the words after the
    # first length - 2 others cannot reach the fixed length.
    kept = F.slice(basic_words(F.col(text), BASED), 1, length - 2).alias("words")
    stored = cut_lineage(spread(df.select(row_id, text)).select(row_id, kept))
    each = stored.select(row_id, F.posexplode_outer("words").alias("pos", "token"))
    counts = each.filter("token is not null").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    words = cut_lineage(split_words(cut_lineage(with_bare(counts)), pieces, unknown["id"], max_bytes))
    joined = lookup(each, words, "token", "n", "left", max_bytes=max_bytes, complete=True)
    one = F.when(F.size(F.coalesce("ids", F.array().cast("array<int>"))) > 0, F.struct("pos", "ids"))
    lists = joined.groupBy(row_id).agg(F.array_sort(F.collect_list(one)).alias("l"))
    flat = F.slice(F.flatten(F.col("l.ids")), 1, length - 2)
    input_ids, mask = padded(flat, length)
    return lists.select(row_id, input_ids.alias("input_ids"), mask.alias("attention_mask"))
