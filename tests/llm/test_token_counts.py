"""Token counts and pieces against the libraries."""

import hashlib
import random

import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpuscat.llm.pieces import Memo, Pieces, encode_decode
from corpuscat.llm.queries import model_path
from corpuscat.llm.tokens import PART_CHARS, count_tokens, neighbours, parts_of

SCHEMA = "doc_id bigint, text string, n_tokens string, id string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    letters = "aeithr  \n\t.,'\"▁é梦😀<s>/\x00129ß"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    long = ["".join(rng.choice(letters + "      ") for _ in range(5 * PART_CHARS)) for _ in range(3)]
    edge = ["", " ", "  ", "\n", "▁", "a ", " a", "a  b ", "</s><unk>", "x" * 30_000, " " * 30_000, "\n" * 20_000, "the " * 9_000, "ab" * 400 + " " + "z" * 400]
    return made + long + edge


def rows_of(texts):
    rows = [(i, t, "clash", "c") for i, t in enumerate(texts)]
    return [*rows, (None, "null id", "c", "c"), (7, texts[7], "c", "c"), (99_999, None, "c", "c")]


def test_counts(spark, library, texts):
    got = count_tokens(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4), model_path()).collect()
    want = {i: len(ids) for i, ids in enumerate(library.encode(texts))} | {None: len(library.encode("null id")), 99_999: 0}
    assert len(got) == len(texts) + 3
    for r in got:
        assert r["n_tokens"] == want[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 4096)
        if r["doc_id"] in range(len(texts)):
            assert r["n_bytes"] == len(texts[r["doc_id"]].encode())


def test_counts_of_a_json_tokenizer(spark, texts):
    plain = Tokenizer.from_file(model_path("byte_bpe_50k.json"))
    some = texts[:40] + ["<|endoftext|> x", ""]
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string"), model_path("byte_bpe_50k.json")).collect()}
    assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) for i, t in enumerate(some)}


def test_parts_join_again(library, texts):
    joined = neighbours(library)
    for t in texts:
        parts = list(parts_of(t, joined, 50))
        assert "".join(p if i == 0 or inner else " " + p for i, (p, inner) in enumerate(parts)) == t


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert count_tokens(df, model_path()).count() == 0 and encode_decode(df, model_path()).count() == 0


def test_pieces(spark, library, texts):
    got = encode_decode(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4), model_path(), with_ids=True).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        t = {None: "null id", 99_999: ""}.get(r["doc_id"]) if r["doc_id"] in (None, 99_999) else texts[r["doc_id"]]
        ids = library.encode(t)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids) and r["library_equal"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_a_heap_and_the_common_agenda_agree(texts):
    pieces = Pieces(model_path())
    words = sorted({c for t in texts for w in pieces.split(t) for c in pieces.word.findall("▁" + w) if len(c) <= 256})
    assert pieces.merge_all(words) == [pieces.merge_long(w) for w in words]


def test_a_full_memo_starts_again(monkeypatch, library, texts):
    from corpuscat.llm import pieces as module

    monkeypatch.setattr(module, "CACHE_WORDS", 50)
    memo = Memo(Pieces(model_path()))
    for t in texts[:80]:
        split = memo.pieces.split(t)
        memo.learn([split])
        assert ",".join(memo.words[w][0] for w in split) == ",".join(map(str, library.encode(t)))
