"""The audit of sources against plain loops."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpuscat.llm import divergence as module
from corpuscat.llm.divergence import audit, run_distance

SCHEMA = "doc_id bigint, text string, lang string, source string, item string, value string, block int"


def plain(rows, support=30, top=50):
    docs = [(r[2] or "", r[3] or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")) for r in rows]
    lower = {c: c + 32 for c in range(65, 91)}
    docs = [(lang, source, [w.translate(lower) for w in words]) for lang, source, words in docs]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        seen[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [w for w, n in seen[lang].items() if n >= support]
        sources = sorted({d[1] for d in docs if d[0] == lang}, key=lambda s: s.encode())
        total = Counter()
        for s in sources:
            total.update(counts[lang, s])

        def shares(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + (10**9 * (c[w] + 5)) // (n + 5 * len(kept)) for w in kept}

        own, q = {s: shares(counts[lang, s]) for s in sources}, shares(total)
        for s in sources:
            pairs = [(sum(abs(own[s][w] - own[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(own[s][w] - q[w], w) for w in kept if counts[lang, s][w] and own[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda e: (-e[0], e[1].encode()))[:most]
                out += [(lang, s, part, i, v, r) for r, (v, i) in enumerate(ranked, 1)]
    return sorted(out)


def found(spark, rows, **kw):
    got = audit(spark.createDataFrame(rows, SCHEMA).repartition(5), **kw)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("block,tile,held", [(4_096, 64, 200_000), (7, 2, 30)])
def test_equals_plain_counts(spark, monkeypatch, block, tile, held):
    """Blocks that end within a language, tiles smaller than its sources, counts passed on early."""
    for name, value in (("BLOCK", block), ("TILE", tile), ("HELD", held)):
        monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(6)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["Éa", "éa", "日本", "x_y", "THE"]
    rows = []
    for i in range(420):
        weights = 1 / (1 + (np.arange(len(words)) + 7 * (i % 5)) % len(words))
        text = " ".join(rng.choice(words, int(rng.integers(0, 40)), p=weights / weights.sum()))
        # A third of the documents are of one source.
        rows.append((i, text, ["en", "de", None][i % 7 % 3], "hot" if i % 3 == 0 else f"s{i % 5}", "i", "v", 1))
    want = plain(rows)
    assert len({r[:2] for r in want}) > 10 and {r[2] for r in want} == {"pair", "term"}
    assert found(spark, rows) == want


def test_edges(spark):
    """Nulls are '', groups without terms stay, repeated rows count, a lone source has no pairs."""
    base = [(1, "The the THE 12 a-b", "en", "s1", None, None, None)] * 40
    rows = base + [(2, None, None, None, None, None, None), (2, "", "", "", "", "", 1), (3, "x" * 300_000 + " The", "en", "s2", "a", "b", 2), (4, "1234 !?", "en", "s3", "a", "b", 2)]
    rows += [(5, "rare", "fr", "s1", "", "", 1), (6, None, "fr", "s2", "", "", 1), (7, "the a b", "en", None, "", "", 1)]
    want = plain(rows)
    assert found(spark, rows) == want
    by = {(r[0], r[1], r[2], r[3]): r for r in want}
    assert by["fr", "s1", "pair", "s2"][4] == 0 and ("en", "s3", "pair", "s1") in by and not [r for r in want if r[0] == ""]
    assert found(spark, rows, support=1, top=2) == plain(rows, 1, 2)
    assert found(spark, []) == []


def test_names_cannot_run_together(spark):
    rows = [(i, "one two", lang, source, "", "", 1) for i, (lang, source) in enumerate([("a", "b:c"), ("a:b", "c"), ("1:a", "b"), ("1", "ab"), ("a", "")] * 31)]
    assert found(spark, rows) == plain(rows)


def test_long_text(spark, monkeypatch):
    monkeypatch.setattr(module, "LONG_TEXT", 10)
    rows = [(i, "alpha beta alpha " * 9, "en", f"s{i % 2}", "", "", 1) for i in range(60)]
    assert found(spark, rows) == plain(rows)


def test_run_distance():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 3, 40), rng.integers(0, 3, 40)
        coded = []
        for x in (a, b):
            ends = np.append(np.flatnonzero(x[1:] != x[:-1]) + 1, len(x))
            coded += [ends, x[ends - 1]]
        assert run_distance(*coded) == np.abs(a - b).sum()
