import sys
import unicodedata

from pyspark.sql import functions as F

from corpuscat.functions.category import canonical_category, collapse_category, multi_hot
from corpuscat.functions.text import clean_text, json_field, prompt, sentences, slug, split_list, words


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def python_clean(text):
    """Letters, numbers and ``_`` stay, all else is blank."""
    kept = "".join(ch if ch.isalnum() or ch == "_" else " " for ch in text.lower())
    return " ".join(kept.split())


def test_clean_text_over_all_code_points(spark):
    chars = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF and unicodedata.category(chr(i)) != "Cn"]
    rows = spark.createDataFrame([(f"a{c}b",) for c in chars], "x string").select("x", clean_text(F.col("x")).alias("y")).collect()
    # Java knows an older Unicode version, so only recent characters may differ.
    assert sum(r["y"] != python_clean(r["x"]) for r in rows) < 6000
    old = [r for r in rows if ord(r["x"][1]) < 0x2000]
    assert sum(r["y"] != python_clean(r["x"]) for r in old) < 60


def test_clean_text_cases(spark):
    assert one(spark, "Café_x²—Ünï!\r\n  A", clean_text) == "café_x² ünï a"
    assert one(spark, None, clean_text) == ""
    assert one(spark, "!!!", clean_text) == ""
    assert one(spark, "Café_x²—Ünï!\r\n  A", words) == ["café_x²", "ünï", "a"]
    assert one(spark, None, words) == []
    again = one(spark, "A--b  C", clean_text)
    assert one(spark, again, clean_text) == again


def test_lists_slugs_prompts(spark):
    assert one(spark, " A, ,b,,C ", split_list) == ["a", "b", "c"]
    assert one(spark, None, split_list) is None
    assert one(spark, "Movies by Origin/Ethnicity", slug) == "Movies_by_Origin_Ethnicity.png"
    assert one(spark, "5% of x", lambda c: prompt("100% {text} end", c)) == "100% 5% of x end"
    assert one(spark, '{"response":" x "}', json_field) == "x"
    assert one(spark, "{}", json_field) == "" and one(spark, None, json_field) == ""
    assert one(spark, "One. Two?! three\n\nfour", sentences) == ["One.", "Two?!", "three", "four"]


def test_categories(spark):
    top = ["drama", "comedy"]
    for value, want in (("melodrama", "drama"), ("comedy, drama", "drama"), ("noir", "noir"), ("comedy", "comedy"), (None, None)):
        assert one(spark, value, lambda c: canonical_category(c, top)) == want
    for value, want in ((None, "other"), ("noir", "other"), ("drama", "drama")):
        assert one(spark, value, lambda c: collapse_category(c, ["drama"])) == want
    assert one(spark, "a,c", lambda c: multi_hot(split_list(c), ["a", "b", "c"])) == [1, 0, 1]
