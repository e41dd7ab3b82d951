"""SentencePiece encoding and decoding with a score-ordered agenda of symbol pairs.

The agenda is kept for all new words of an Arrow batch at once: one array holds the rank of
each adjacent pair, and each round takes the best pair of every word, leftmost on ties, as
a heap would give it. Very long words have a heap of their own.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscat.llm.batches import slices
from corpuscat.llm.tokens import SPACE, neighbours

LONG = 256  # words with more symbols than this have a heap of their own
SLICE_BYTES = 4 << 20
CACHE_WORDS = 300_000
ROUND_WORDS = 4_096  # words of like length whose agendas run together
_LAST = 1 << 30  # rank of no pair
_SLOT_BITS = 18
# Fixed odd hash multipliers.
_ODD = np.array([-7046029254386353131, -4417276706812531889, 1609587929392839161], np.int64)
_CHAR = 1 << 20  # symbols from here on are characters without a piece


_SPACED = re.compile(f"{SPACE}+[^{SPACE}]*")


class Pieces:
    """A merge-type vocabulary with byte fallback, read through the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
        self.piece = {i: p.id_to_piece(i) for i in normal}
        self.shown = {i: t.replace(SPACE, " ") for i, t in self.piece.items()}
        ids = {t: i for i, t in self.piece.items()}
        self.space = ids[SPACE]
        self.byte = {int(p.id_to_piece(i)[1:-1], 16): i for i in range(p.vocab_size()) if p.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        if any(SPACE in t.lstrip(SPACE) for t in ids) or len(self.byte) != 256 or any(p.is_unused(i) for i in normal):
            raise ValueError("the vocabulary must have spaces at the start of pieces only, all bytes and no unused pieces")
        singles = sorted((ord(t), i) for t, i in ids.items() if len(t) == 1)
        self.char, self.char_id = (np.array(x, np.int64) for x in zip(*singles))
        # Rank by falling score; equal scores share a rank and go left to right.
        scores = sorted({p.get_score(i) for i in normal}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        pairs = {}
        symbol = lambda t: ids.get(t, _CHAR + ord(t) if len(t) == 1 else None)
        for t, i in ids.items():
            for cut in range(1, len(t)):
                a, b = symbol(t[:cut]), symbol(t[cut:])
                if a is not None and b is not None:
                    pairs[(a << 22) | b] = (i, rank[p.get_score(i)])
        self.pairs = pairs
        self.key = np.array(sorted(pairs), np.int64)
        self.made, self.rank = (np.append(np.array(x, np.int64), y) for x, y in zip(zip(*(pairs[k] for k in self.key.tolist())), (-1, _LAST)))
        self.tables = self._tables()
        # Marks that no piece has behind a letter: a word may be cut before them, and at line ends.
        inner = neighbours(self.library)
        marks = "".join(c for c in ".,;:!?%#$&*\"'" if not any(b == c and a.isalpha() for a, b in inner))
        if any("\n" in pair for pair in inner) or any(b == SPACE and a != SPACE for a, b in inner):
            raise ValueError("no piece may hold a line end, or a space behind another character")
        m = re.escape(marks) or "\n"
        self.word = re.compile(f"\n|{SPACE}*[^{SPACE}\n{m}]*[^\\W\\d_](?=[{m}])|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def _tables(self) -> list[np.ndarray]:
        """Places of the pairs by hash; what collides in one table is in the next."""
        tables, left = [], np.arange(len(self.key))
        while len(left):
            slot = self._slot(self.key[left], len(tables))
            table = np.full(1 << _SLOT_BITS, len(self.key), np.int32)
            table[slot[::-1]] = left[::-1]
            tables.append(table)
            left = left[table[slot] != left]
        self.key = np.append(self.key, -1)
        return tables

    @staticmethod
    def _slot(key: np.ndarray, n: int) -> np.ndarray:
        return ((key * _ODD[n % len(_ODD)]).view(np.uint64) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)

    def split(self, text: str) -> list[str]:
        """Words of a text, each without the first of its space marks: no merge crosses them."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _SPACED.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair of symbols."""
        key = (a << 22) | b
        found = np.full(len(key), len(self.key) - 1, np.int64)
        for n, table in enumerate(self.tables):
            at = table[self._slot(key, n)]
            hit = self.key[at] == key
            found[hit] = at[hit]
        return self.rank[found], self.made[found]

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start symbols of all words in a row, and the number of each."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.char, code), len(self.char) - 1)
        return np.where(self.char[at] == code, self.char_id[at], _CHAR + code), np.array([len(w) for w in words], np.int64)

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """Final symbols of each word: agendas of all words, round by round."""
        out: list[list[int]] = [[]] * len(words)
        sym, size = self.symbols(words)
        who = np.arange(len(words))
        rank, made = self._pair_ranks(sym, size)
        while len(sym):
            starts = np.cumsum(size) - size
            order = (rank << 32) | np.arange(len(sym))
            best = np.minimum.reduceat(order, starts)
            ended = (best >> 32) >= _LAST
            if ended.any():
                stay = np.repeat(~ended, size)
                flat, p = sym[~stay].tolist(), 0
                for k, n in zip(who[ended].tolist(), size[ended].tolist()):
                    out[k] = flat[p : p + n]
                    p += n
                sym, rank, made = sym[stay], rank[stay], made[stay]
                best, size, who = best[~ended], size[~ended], who[~ended]
                if not len(sym):
                    break
                # Positions move up as finished words go.
                moved = np.cumsum(stay) - 1
                at = moved[best & 0xFFFFFFFF]
            else:
                at = best & 0xFFFFFFFF
            sym[at] = made[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, rank, made = sym[stay], rank[stay], made[stay]
            at = (np.cumsum(stay) - 1)[at]
            size = size - 1
            ends = np.cumsum(size)
            last = np.zeros(len(sym), bool)
            last[ends - 1] = True
            first = np.zeros(len(sym), bool)
            first[ends - size] = True
            # Only pairs beside a new symbol have changed.
            fresh = np.concatenate([at, at[~first[at]] - 1])
            none = last[fresh]
            rank[fresh[none]], made[fresh[none]] = _LAST, -1
            fresh = fresh[~none]
            rank[fresh], made[fresh] = self.look_up(sym[fresh], sym[fresh + 1])
        return out

    def _pair_ranks(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(sym), _LAST), np.full(len(sym), -1, np.int64)
        inside = np.ones(len(sym), bool)
        inside[np.cumsum(size) - 1] = False
        k = np.flatnonzero(inside)
        rank[k], made[k] = self.look_up(sym[k], sym[k + 1])
        return rank, made

    def merge_long(self, word: str) -> list[int]:
        """Final symbols of one long word, with a heap of pairs over linked symbols."""
        sym = self.symbols([word])[0].tolist()
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            found = self.pairs.get((sym[i] << 22) | sym[j]) if i >= 0 and j >= 0 else None
            if found:
                heapq.heappush(heap, (found[1], i, sym[i], sym[j]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # one of the two has been merged since
            sym[i], sym[j] = self.pairs[(a << 22) | b][0], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(left[i], i)
            push(i, right[i])
        return [s for s in sym if s >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, which starts with its space mark; characters without a piece become bytes."""
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        out: list[list[int]] = [[]] * len(words)
        for s in range(0, len(order), ROUND_WORDS):
            ks = order[s : s + ROUND_WORDS]
            short = [words[k] for k in ks if len(words[k]) <= LONG]
            merged = self.merge_all(short) + [self.merge_long(words[k]) for k in ks[len(short) :]]
            for k, sym in zip(ks, merged):
                if max(sym) >= _CHAR:
                    sym = [x for y in sym for x in ([y] if y < _CHAR else [self.byte[b] for b in chr(y - _CHAR).encode()])]
                out[k] = sym
        return out

    def decode_word(self, ids: list[int]) -> str:
        """Text of the ids of one word, with the space before it."""
        try:
            return "".join([self.shown[i] for i in ids])
        except KeyError:  # bytes among the ids
            return b"".join([bytes([self.value[i]]) if i in self.value else self.shown[i].encode() for i in ids]).decode()

    def library_ids(self, words: list[str]) -> list[list[int]]:
        """The library's ids of each word.

        It puts a space mark before each text: that is the word's own first mark, or one
        that a line end keeps apart.
        """
        own = [w[0] == SPACE and len(w) > 1 for w in words]
        found = self.library.encode([w[1:] if o else "\n" + w for w, o in zip(words, own)], num_threads=1)
        return [ids if o else ids[2:] for ids, o in zip(found, own)]


class Memo:
    """What words encode and decode to, for a bounded number of words and of their chunks."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.words: dict[str, tuple[str, int, str, bool]] = {}
        self.chunks: dict[str, tuple[str, int, str, bool]] = {}

    def learn(self, split: list[list[str]]) -> None:
        """Take in all words of ``split``; new chunks go through the agenda and the library."""
        new = {w for words in split for w in words if w not in self.words}
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = {w for words in split for w in words}
        cut = {w: self.pieces.word.findall(SPACE + w) for w in new}
        if len(self.chunks) > CACHE_WORDS:
            self.chunks.clear()
        chunks = list({c for found in cut.values() for c in found if c not in self.chunks})
        if chunks:
            ids, theirs = self.pieces.encode_words(chunks), self.pieces.library_ids(chunks)
            # The library drops the space before a text: a space mark in front keeps the chunk's.
            their_text = self.pieces.library.decode([[self.pieces.space, *i] for i in theirs])
            for c, own, lib, lib_text in zip(chunks, ids, theirs, their_text):
                text = self.pieces.decode_word(own)
                self.chunks[c] = (",".join(map(str, own)), len(own), text, own == lib and text == lib_text)
        known = self.chunks
        for w, found in cut.items():
            if len(found) == 1:
                self.words[w] = known[found[0]]
            else:
                parts = [known[c] for c in found]
                self.words[w] = (",".join([p[0] for p in parts]), sum([p[1] for p in parts]), "".join([p[2] for p in parts]), all([p[3] for p in parts]))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_tokens, ids_sha256, decoded_sha256, library_equal``.

    With ``with_ids`` also ``ids`` and ``decoded``. Whole texts are encoded without ids at
    the ends and decoded again. Words are cut where no piece of the vocabulary can cross,
    each new one in an Arrow batch goes through the agenda, and its ids and decoded text are
    compared with the library's: ``library_equal`` says whether all words of a text agree.
    The memo of words has a fixed size.

    Null texts are empty: no ids and an empty text. Repeated rows and null ids are rows
    like others; other columns are not read. ``path`` must exist on each executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, library_equal boolean"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        memo = Memo(pieces)
        for batch in batches:
            for start, end in slices(batch.column(1), SLICE_BYTES):
                texts = batch.column(1).slice(start, end - start).to_pylist()
                split = [pieces.split(t) for t in texts]
                memo.learn(split)
                columns: list[list] = [[], [], [], [], [], []]
                for words in split:
                    found = [memo.words[w] for w in words]
                    shown, text = ",".join([f[0] for f in found]), "".join([f[2] for f in found])[1:]
                    columns[0].append(sum([f[1] for f in found]))
                    columns[1].append(hashlib.sha256(shown.encode()).hexdigest())
                    columns[2].append(hashlib.sha256(text.encode()).hexdigest())
                    columns[3].append(all([f[3] for f in found]))
                    if with_ids:
                        columns[4].append([int(i) for i in shown.split(",")] if shown else [])
                        columns[5].append(text)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.string()]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "library_equal", "ids", "decoded"]
                n = 6 if with_ids else 4
                arrays = [batch.column(0).slice(start, len(texts))] + [pa.array(c, k) for c, k in zip(columns[:n], kinds[:n])]
                yield pa.RecordBatch.from_arrays(arrays, names=names[: n + 1])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
