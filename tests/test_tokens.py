import numpy as np
import pytest
from tokenizers import BertWordPieceTokenizer
from pyspark.sql import functions as F

from corpuscat.operators import subword, summary, tokens
from corpuscat.operators.scale import lookup


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string")


def encoded(df):
    return {r["i"]: (r["input_ids"], r["attention_mask"]) for r in df.collect()}


def test_vocabulary_order(spark):
    rows = tokens.vocabulary(docs(spark, "b a a", "c, B?"), "t").orderBy("id").collect()
    assert [(r["token"], r["id"], r["n"]) for r in rows] == [("a", 4, 2), ("b", 5, 2), ("c", 6, 1)]


def test_encode_edges(spark):
    df = docs(spark, "!!!", None, "a b c d e f g h i j", "a zzz")
    vocab = tokens.vocabulary(docs(spark, "a b c d e f g h i j"), "t")
    got = encoded(tokens.encode(df, "i", "t", vocab, 4))
    assert got[0] == ([2, 3, 0, 0], [1, 1, 0, 0]) and got[1] == got[0]
    assert got[2] == ([2, 4, 5, 3], [1, 1, 1, 1])
    assert got[3] == ([2, 4, 1, 3], [1, 1, 1, 1])


def test_encode_with_a_vocabulary_beyond_the_broadcast(spark, monkeypatch):
    df = docs(spark, *[" ".join(f"w{(i * j) % 97}" for j in range(60)) for i in range(40)], "", None, "nowhere")
    vocab = tokens.vocabulary(df.filter("i < 30"), "t")
    want = encoded(tokens.encode(df, "i", "t", vocab, 32))
    monkeypatch.setattr(tokens, "lookup", lambda *a: lookup(*a, max_bytes=1500))
    assert encoded(tokens.encode(df, "i", "t", vocab, 32)) == want
    assert all(len(i) == 32 and sum(m) == sum(x != 0 for x in i) for i, m in want.values())


def test_stored_vocabulary_keeps_its_ids(spark, tmp_path):
    vocab = tokens.vocabulary(docs(spark, "b a a c", "c a"), "t")
    tokens.save_vocabulary(vocab.drop("id"), str(tmp_path / "v"))
    back = tokens.load_vocabulary(spark, str(tmp_path / "v"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, vocab.collect())) == [("a", 4, 3), ("b", 6, 1), ("c", 5, 2)]
    vocab.filter("id <> 5").write.parquet(str(tmp_path / "w"))
    with pytest.raises(ValueError):
        tokens.load_vocabulary(spark, str(tmp_path / "w"))


def test_subword_equals_the_published_scheme(spark):
    pieces = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]
    pieces += list("abcdefghijklmnopqrstuvwxyz0123456789.,!?$'-") + ["##" + c for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    pieces += ["the", "play", "##ing", "##ed", "un", "##believ", "##able", "cafe", "中", "strasse", "##ss"]
    ids = {p: i for i, p in enumerate(pieces)}
    theirs = BertWordPieceTokenizer(vocab=ids, lowercase=True)
    theirs.enable_truncation(24)
    theirs.enable_padding(length=24)
    texts = [
        "The CAFÉ, playing unbelievable!",
        "it's $5.00\tplayed\r\nagain",
        "中文 mix",
        "x" * 120,
        "",
        "été ça über 日",
        "a​b ́ c",
        "one two three four five six seven eight nine ten eleven",
        "tab\tnew\nline\x07bell",
        "semi;colon^caret`tick|pipe~tilde<>=+",
    ]
    table = spark.createDataFrame(list(ids.items()), "piece string, id int")
    for max_bytes in (1 << 26, 0):
        got = encoded(subword.subword_encode(docs(spark, *texts), "i", "t", table, 24, max_bytes=max_bytes))
        for i, text in enumerate(texts):
            want = theirs.encode(text)
            assert got[i] == (want.ids, want.attention_mask), text


def test_subword_vocabulary_of_any_size(spark):
    """200,000 pieces, and one letter that most parts of most words are."""
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    made = {"".join(rng.choice(letters, int(n))) for n in rng.integers(4, 9, 215_000)}
    stems = sorted(made)[:200_000]
    pieces = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *letters, *("##" + c for c in letters[:-1])]
    pieces += [w if i % 2 else "##" + w for i, w in enumerate(stems)]
    ids = {p: i for i, p in enumerate(pieces)}
    assert len(ids) > 200_000
    theirs = BertWordPieceTokenizer(vocab=ids, lowercase=True)
    theirs.enable_truncation(40)
    theirs.enable_padding(length=40)
    texts = [" ".join("".join(rng.choice(stems, 2)) if rng.random() < 0.7 else "a" * int(rng.integers(1, 100)) for _ in range(12)) for _ in range(60)] + ["az zz", "z" * 101]
    got = encoded(subword.subword_encode(docs(spark, *texts), "i", "t", spark.createDataFrame(list(ids.items()), "piece string, id int"), 40))
    for i, text in enumerate(texts):
        want = theirs.encode(text)
        assert got[i] == (want.ids, want.attention_mask), text


def test_subword_needs_an_unknown_piece(spark):
    with pytest.raises(ValueError):
        subword.subword_encode(docs(spark, "a"), "i", "t", spark.createDataFrame([("a", 5)], "piece string, id int"))


def test_length_profile(spark):
    r = tokens.length_profile(docs(spark, "a b", "a", "", "a b c"), "t", limit=4).first()
    assert tuple(r) == (4, 1.5, 0.75, 1.5, 2.25, 3, 0.25)


def test_extractive_summary(spark):
    df = docs(spark, "Rare words here. the the cat", "", "the cat! the cat?")
    got = {r["i"]: r["summary"] for r in summary.extractive_summary(df, "i", "t").collect()}
    assert got == {0: "the the cat", 1: "", 2: "the cat!"}
    weights = spark.createDataFrame([("rare", 90), ("words", 1)], "token string, n bigint")
    got = {r["i"]: r["summary"] for r in summary.extractive_summary(df, "i", "t", weights).collect()}
    assert got[0] == "Rare words here."


def test_repeated_ids_and_large_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (None, "b"), (2, None)], "i int, t string")
    vocab = spark.createDataFrame([("a", 2_000_000_000, 3), ("b", 7, 2)], "token string, id bigint, n bigint")
    got = encoded(tokens.encode(df, "i", "t", vocab, 6))
    assert got == {1: ([2, 1, 2_000_000_000, 7, 3, 0], [1, 1, 1, 1, 1, 0]), None: ([2, 7, 3, 0, 0, 0], [1] * 3 + [0] * 3), 2: ([2, 3, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0])}


def test_words_of_texts_are_taken_once(spark, monkeypatch):
    """Words are looked up, and counted, from a stored table and not from the texts."""
    seen = []

    def kept(rows, *a, **k):
        seen.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return lookup(rows, *a, **k)

    df = docs(spark, "Rare words here. the the cat", "", "the cat! the cat?", None)
    vocab = tokens.vocabulary(df, "t")
    for module in (tokens, summary, subword):
        monkeypatch.setattr(module, "lookup", kept)
    tokens.encode(df, "i", "t", vocab, 8)
    summary.extractive_summary(df, "i", "t")
    subword.subword_encode(df, "i", "t", spark.createDataFrame([("[UNK]", 1), ("a", 2)], "piece string, id int"), 8)
    assert len(seen) == 4 and not any("regexp_extract" in p for p in seen)


def test_words_with_more_than_accents_in_one_pass(spark):
    texts = ["a\u0301b \u0301 \u0301c \u0301\u0301", "x.\u0301!\u4e2d\u0301y", "", None, "\u0301a\u0301 \u0301\u0301\u0301.b"]
    kept = F.filter(subword.basic_words(F.col("t")), lambda w: w.rlike(r"[^\p{Mn}]"))
    for r in docs(spark, *texts).select(kept.alias("two"), subword.basic_words(F.col("t"), subword.BASED).alias("one")).collect():
        assert r["one"] == r["two"]
