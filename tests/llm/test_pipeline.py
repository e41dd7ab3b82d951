"""The pipeline, stage by stage, against plain Python over what each stage was given."""

import hashlib
import re
from collections import Counter

import pytest
import sentencepiece
from conftest import SF
from test_exact import norm
from test_mixing import targets
from test_near import brute

import corpus_pipeline
from corpuscat.llm.queries import model_path


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return [d.collect() for d in out], [d.columns for d in out]


def test_columns(stages):
    _, columns = stages
    assert all(c == columns[0] for c in columns[1:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mix", "pieces"]


def test_language_keeps_clean_documents(stages):
    (before, after, *_), _ = stages
    assert {r["doc_id"] for r in before} >= {r["doc_id"] for r in after}
    assert len(after) >= 0.98 * len(before)


def test_exact(stages):
    (_, before, after, *_), _ = stages
    first = {}
    for r in before:
        first[norm(r["text"])] = min(r["doc_id"], first.get(norm(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in after) == sorted(first.values())


def test_near(stages):
    (_, _, before, after, *_), _ = stages
    classes = brute([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(set(classes.values()))


def test_mix(stages):
    (_, _, _, before, after, _), _ = stages
    size = lambda r: len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += size(r)
    for r in after:
        taken[r["source"]] += size(r)
    largest = {s: max(size(r) for r in before if r["source"] == s) for s in sizes}
    for s, want in targets(dict(sizes)).items():
        assert abs(taken[s] - want) <= largest[s], s
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2


def test_pieces(stages):
    (*_, before, after), _ = stages
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = Counter()
    for r in before:
        ids = library.encode(r["text"] or "")
        want[(r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after) == want
    assert all(r["library_equal"] for r in after)


def test_edge_rows_pass_through(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, "12 !", "en", None, 4), (None, "the and of in that with", "en", "a", 5), (4, "the and of in that with", "en", "a", 5),
            (4, "the and of in that with", "en", "a", 5), (5, "the and of " * 20_000, None, None, 5)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        got = docs.collect()
        assert all(r["doc_id"] is None or r["doc_id"] > 3 for r in got)
