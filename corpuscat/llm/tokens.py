"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscat.llm.batches import slices

SPACE = "▁"  # fixed value: the library's mark for a space
PART_CHARS = 8_192  # longer texts are split
BATCH_BYTES = 1 << 20  # texts encoded in one call
LIMIT = 4_096


def neighbours(processor) -> set[tuple[str, str]]:
    """The pairs of characters that stand side by side within any piece of the vocabulary.

    Merges only build pieces, so none ever joins two characters that are not among these:
    a text may be cut between them and the counts of the parts add up.
    """
    found = set()
    for i in range(processor.vocab_size()):
        if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i)):
            piece = processor.id_to_piece(i)
            found.update(zip(piece, piece[1:]))
    return found


def parts_of(text: str, joined: set[tuple[str, str]], most: int = PART_CHARS) -> Iterator[tuple[str, bool]]:
    """``text`` in parts of about ``most`` characters, cut at safe boundaries only.

    A part with True goes on after a cut that was not at a space, so the space which the
    library puts before each text must be kept from it. At a cut before a space, that space
    is left out, as the library puts it back. Where no cut is safe the part grows.
    """
    start, inner, n = 0, False, len(text)
    while n - start > most:
        cut = start + most
        while cut < n:
            a, b = text[cut - 1], text[cut]
            pair = (SPACE if a == " " else a, SPACE if b == " " else b)
            if pair not in joined and (b != " " or cut + 1 < n):
                break
            cut += 1
        if cut == n:
            break
        yield text[start:cut], inner
        inner = text[cut] != " "
        start = cut if inner else cut + 1
    yield text[start:], inner


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, for the model at ``path``."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    joined = neighbours(processor)
    # A line end before a part keeps the library's space apart from it, if no piece has one.
    guard = "\n"
    # Cuts need the plain layout: no normalisation, and a space before each text.
    plain = processor.encode("ﬁ  é", out_type=str) == processor.encode(f"ﬁ{SPACE}{SPACE}é", out_type=str)
    plain = plain and processor.decode(processor.encode(" ﬁ  é ")) == " ﬁ  é "
    plain = plain and processor.encode("a", out_type=str)[0].startswith(SPACE) and not any(guard in p for p in joined)
    extra = len(processor.encode(guard))

    def count(texts: list[str]) -> list[int]:
        owner, parts, minus = [], [], []
        for i, text in enumerate(texts):
            for part, inner in parts_of(text, joined) if plain and len(text) > PART_CHARS else ((text, False),):
                owner.append(i)
                parts.append(guard + part if inner else part)
                minus.append(extra if inner else 0)
        out = [0] * len(texts)
        for i, ids, m in zip(owner, processor.encode(parts, num_threads=1), minus):
            out[i] += len(ids) - m
        return out

    return count


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_bytes, n_tokens, over_limit``.

    Whole texts are encoded as the library of the model at ``path`` does, without special
    tokens at the ends, in calls of about equal bytes. Only lengths leave the worker. Null
    texts are empty and have 0 tokens; repeated rows and null ids are rows like others, and
    other columns are not read. ``path`` must exist on each executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            n_tokens: list[int] = []
            for start, end in slices(batch.column(2), BATCH_BYTES):
                n_tokens += count(batch.column(2).slice(start, end - start).to_pylist())
            lengths = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lengths], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
