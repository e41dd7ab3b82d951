"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuscat.llm.batches import slices

BUCKETS = 1 << 15
WIDTH = 16
GRAMS = (2, 3, 4)  # bytes of a subword, a word's border counting as one
FIT_PER_LANGUAGE = 800  # labelled rows of each language that a fit reads, at most about
FIT_CHARS = 1_500  # characters of such a row that it reads, from a place set by its id
SHORT = (40, 300)  # lengths of the excerpts that a fit adds, so that short texts are known too
REJECT_SHARE = 0.001  # share of good held-back texts that may fall below each threshold
SEEN_IN = 3  # rows of the fit that a subword's bucket must occur in to be a known one
UNKNOWN = "und"
SLICE_BYTES = 1 << 20

# Fixed hash multipliers, odd numbers.
_MULTIPLY = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
# Bytes as they count: ASCII letters in lower case, bytes of other letters, else a border.
_FOLD = np.full(256, 32, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalpha():
        _FOLD[_b] = ord(chr(_b).lower()) if _b < 128 else _b


@dataclass
class Model:
    """Class scores per bucket (embeddings times output layer), with temperature and thresholds.

    ``seen`` marks the buckets that the fit has met. ``caught`` is the share of made negatives
    that the thresholds rejected when they were set.
    """

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    seen: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    least_known: float = 0.0
    caught: float = 0.0

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """One row per text; a text without subwords has the prior only."""
        return self.judge(texts)[0]

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``probabilities``, and the share of each text's subwords that are known."""
        grams, owner = subwords(texts)
        n = np.bincount(owner, minlength=len(texts)).astype(np.float64)
        total = np.empty((len(texts), len(self.languages)))
        for c in range(len(self.languages)):
            total[:, c] = np.bincount(owner, weights=self.scores[c][grams], minlength=len(texts))
        known = np.bincount(owner, weights=self.seen[grams], minlength=len(texts)) / np.maximum(n, 1.0)
        return softmax((total / np.maximum(n, 1.0)[:, None] + self.bias) / self.temperature), known


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all subwords of ``texts``, and the text of each."""
    data = [f" {t.lower()} ".encode(errors="replace") for t in texts]
    b = _FOLD[np.frombuffer(b"".join(data), np.uint8)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(d) for d in data])
    # One border between the words of a text.
    edge = b == 32
    keep = np.ones(len(b), bool)
    keep[1:] = ~(edge[1:] & edge[:-1] & (owner[1:] == owner[:-1]))
    b, owner, edge = b[keep], owner[keep], edge[keep]
    grams, owners = [], []
    for n in GRAMS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = (h ^ b[k : k + m]) * _MULTIPLY[k]
            h ^= h >> np.uint32(15)
        inside = np.zeros(m, bool)
        for k in range(1, n - 1):
            inside |= edge[k : k + m]
        ok = ~inside & (owner[:m] == owner[n - 1 : n - 1 + m])
        if n == 2:
            ok &= ~(edge[:m] & edge[1 : m + 1])
        grams.append((h & np.uint32(BUCKETS - 1))[ok])
        owners.append(owner[:m][ok])
    return (np.concatenate(grams), np.concatenate(owners)) if grams else (np.zeros(0, np.uint32), np.zeros(0, np.int32))


def fit(texts: list[str], langs: list[str], seed: int = 11, epochs: int = 6, rate: float = 4.0) -> Model:
    """Fit embeddings and output layer by stochastic gradient descent, then calibrate.

    A fifth of the texts is held back. On it a temperature is chosen by log loss, and the
    thresholds below which a text is rejected (``_calibrate``).
    """
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = set(order[: len(texts) // 5].tolist()) if len(texts) >= 10 else set()
    cut_texts: dict[bool, list[tuple[str, int]]] = {False: [], True: []}
    for i in order.tolist():
        y = languages.index(langs[i])
        cut_texts[i in held].append((texts[i], y))
        for size in SHORT:
            at = int(rng.integers(0, max(1, len(texts[i]) - size)))
            cut_texts[i in held].append((texts[i][at : at + size], y))
    rows = cut_texts[False]
    counts = _histograms([t for t, _ in rows])
    y = np.array([k for _, k in rows])
    emb = rng.uniform(-1.0 / WIDTH, 1.0 / WIDTH, (BUCKETS, WIDTH))
    out, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        shuffled = rng.permutation(len(rows))
        for s in range(0, len(shuffled), 32):
            chosen = [k for k in shuffled[s : s + 32].tolist() if len(counts[k][0])]
            if not chosen:
                continue
            ids = np.concatenate([counts[k][0] for k in chosen])
            share = np.concatenate([counts[k][1] for k in chosen])
            starts = np.cumsum([0, *[len(counts[k][0]) for k in chosen][:-1]])
            hidden = np.add.reduceat(emb[ids] * share[:, None], starts, axis=0)
            error = softmax(hidden @ out + bias)
            error[np.arange(len(chosen)), y[chosen]] -= 1.0
            error /= len(chosen)
            back = error @ out.T
            out -= step * (hidden.T @ error)
            bias -= 0.1 * step * error.sum(axis=0)
            sizes = [len(counts[k][0]) for k in chosen]
            grad = np.repeat(back, sizes, axis=0) * share[:, None]
            for w in range(WIDTH):  # sums per bucket, one column at a time
                emb[:, w] -= step * 20 * np.bincount(ids, weights=grad[:, w], minlength=BUCKETS)
    # Excerpts are cut from whole rows, so only every row's first entry counts.
    met = np.bincount(np.concatenate([ids for ids, _ in counts[:: 1 + len(SHORT)]]), minlength=BUCKETS)
    seen = (met >= min(SEEN_IN, len(rows) // (1 + len(SHORT)))).astype(np.float64)
    model = Model(languages, np.ascontiguousarray((emb @ out).T.astype(np.float32)), bias, seen)
    if held:
        _calibrate(model, cut_texts[True], rng)
    return model


def _histograms(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        ids, n = np.unique(subwords([t])[0], return_counts=True)
        out.append((ids, n / max(n.sum(), 1)))
    return out


def _calibrate(model: Model, rows: list[tuple[str, int]], rng: np.random.Generator) -> None:
    """Set temperature and thresholds on held-back texts.

    A score is low, and few subwords are known, in a text of no language of the fit. How low
    a good text can be is read off the held-back ones: excerpts that are recognised, and for
    the score also texts half in one language and half in another, which are clean and stay.
    All but ``REJECT_SHARE`` of them pass each threshold. Texts whose letters are shuffled, or
    swapped for others throughout, are of no language; where most of them lie below the good
    ones, the threshold is half way between, so that names, numbers and rare words do no harm.
    """
    y = np.array([k for _, k in rows])
    texts = [t for t, _ in rows]
    p, known = model.judge(texts)
    p = np.log(np.maximum(p, 1e-300))
    model.temperature = min((-np.log(np.maximum(softmax(p / t)[np.arange(len(y)), y], 1e-12)).mean(), t) for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0))[1]
    q = softmax(p / model.temperature)
    right = q.argmax(axis=1) == y
    if not right.any():
        return
    other = rng.permutation(len(texts))
    mixed = []
    for i, j in enumerate(other.tolist()):
        if y[i] != y[j]:
            half = min(len(texts[i]), len(texts[j])) // 2
            mixed.append(f"{texts[i][:half]} {texts[j][:half]}")
    good = np.concatenate([q.max(axis=1)[right], model.probabilities(mixed).max(axis=1)]) if mixed else q.max(axis=1)[right]
    strange, less = model.judge([negative(t, rng) for t in texts])
    model.threshold = _between(strange.max(axis=1), good)
    model.least_known = _between(less, known[right])
    model.caught = float(((strange.max(axis=1) < model.threshold) | (less < model.least_known)).mean())


def _between(bad: np.ndarray, good: np.ndarray) -> float:
    least = float(np.quantile(good, REJECT_SHARE))
    return min(least, (least + float(np.median(bad))) / 2)


def negative(text: str, rng: np.random.Generator) -> str:
    """A text of no language: its letters shuffled, or each of them swapped for another one."""
    if rng.integers(2):
        return "".join(text[k] for k in rng.permutation(len(text)))
    letters = sorted({c for c in text.lower() if c.isalpha()})
    swap = dict(zip(letters, rng.permutation(letters).tolist() if letters else []))
    return "".join(swap.get(c, c) for c in text.lower())


def held_out(id_col: Column) -> Column:
    """True for the fifth of the ids that no fit may see."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = FIT_PER_LANGUAGE) -> Model | None:
    """A model of the labelled rows of ``docs`` that are not held out, or None if there are none.

    Languages are counted over all rows. About ``per_language`` rows of each, chosen by a
    hash of the id, reach the driver, each cut to ``FIT_CHARS`` characters; the number of
    languages is taken to be small, as codes of languages are.
    """
    key, lang = F.col(f"`{id_col}`"), F.col(f"`{lang_col}`")
    known = docs.filter(lang.isNotNull() & key.isNotNull() & F.col(f"`{text_col}`").isNotNull() & ~held_out(key))
    counts = {r["l"]: r["n"] for r in known.groupBy(lang.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(lang == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    place = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    text = F.col(f"`{text_col}`")
    start = F.pmod(F.xxhash64(key, F.lit(5)), F.greatest(F.length(text) - FIT_CHARS, F.lit(1))).cast("int") + 1
    sample = known.filter(place < share).select(key.alias("i"), lang.alias("l"), F.substring(text, start, F.lit(FIT_CHARS)).alias("t"))
    rows = sample.toArrow().sort_by([("i", "ascending"), ("t", "ascending")])
    return fit(rows["t"].to_pylist(), rows["l"].to_pylist())


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected``.

    A whole text's subword scores are averaged; ``score`` is the calibrated probability of
    the best language. A null text or one without a letter is ``und`` with score 0 and
    rejected, as is every text where there was nothing to fit on; a text below one of the
    model's thresholds keeps its best language and is rejected. Columns of those names are replaced,
    other columns pass through; repeated rows are rows like others.
    """
    added = ["lang_pred", "score", "rejected"]
    own = [c for c in docs.columns if c not in added]
    rows = docs.select(*[F.col(f"`{c}`") for c in own])
    at = own.index(text_col)
    schema = StructType([*rows.schema.fields]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(at), SLICE_BYTES):
                part = batch.slice(start, end - start)
                texts = [t or "" for t in part.column(at).to_pylist()]
                lettered = [model is not None and any(map(str.isalpha, t)) for t in texts]
                if model is None:
                    best, score, known = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
                else:
                    p, known = model.judge(texts)
                    best, score = p.argmax(axis=1), p.max(axis=1)
                names = [model.languages[k] if on else UNKNOWN for k, on in zip(best.tolist(), lettered)]
                scores = np.where(lettered, score, 0.0)
                rejected = ~np.array(lettered, bool)
                if model is not None:
                    rejected |= (scores < model.threshold) | (known < model.least_known)
                more = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected.tolist(), pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*own, *added])

    return rows.mapInArrow(run, schema)


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` in a language that a model fitted on them knows.

    Null texts and texts without a letter go, and all rows where there is nothing to fit on
    (an empty table gives an empty result). Rows that repeat stay as often as they are there.
    Columns named like those of ``predict`` keep their own values.
    """
    model = fit_on(docs, id_col, text_col, lang_col)
    away = {c: f"_own_{c}" for c in docs.columns if c in ("lang_pred", "score", "rejected")}
    found = predict(docs.withColumnsRenamed(away), model, text_col).filter("not rejected").drop("lang_pred", "score", "rejected")
    return found.withColumnsRenamed({v: k for k, v in away.items()})
