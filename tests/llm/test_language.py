"""Language identification: held-out accuracy, short texts, edges."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from corpuscat.llm.language import drop_rejected, fit, fit_on, held_out, negative, predict, subwords

SCHEMA = "doc_id bigint, text string, lang string, score string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_on(docs)
    found = predict(docs, model).filter(held_out(F.col("doc_id")))
    n, right, rejected = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int"))).first()
    assert n > 100 and right / n > 0.97 and rejected / n < 0.02
    again = fit_on(docs.repartition(3))
    assert (again.scores == model.scores).all() and again.threshold == model.threshold


def test_only_the_text_decides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_on(docs)
    moved = docs.limit(200).select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    a = {r["text"]: (r["lang_pred"], r["score"]) for r in predict(moved, model).collect()}
    b = {r["text"]: (r["lang_pred"], r["score"]) for r in predict(docs.limit(200), model).collect()}
    assert a == b


EDGE = [(1, None, None, "s"), (2, "", "en", "s"), (3, "12 34 !?", "en", "s"), (4, "the and of in that", "en", None), (5, "der die und von in", "de", "s"),
        (5, "der die und von in", "de", "s"), (None, "the of and", "en", "s"), (6, "梦梦", None, "s"), (7, "the of " * 60_000, "en", "s")]


def test_edges(spark):
    model = fit(["the and of in that with for this"] * 20 + ["der die und von in den ist mit"] * 20, ["en"] * 20 + ["de"] * 20)
    got = predict(spark.createDataFrame(EDGE, SCHEMA).repartition(3), model).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (1, 2, 3))
    assert by[4]["lang_pred"] == by[7]["lang_pred"] == by[None]["lang_pred"] == "en" and by[5]["lang_pred"] == "de"
    assert by[6]["lang_pred"] in ("en", "de")


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([(1, "text", None, "s")], SCHEMA)
    assert fit_on(none) is None and predict(none, None).first()["lang_pred"] == "und"
    empty = spark.createDataFrame([], SCHEMA)
    assert predict(empty, fit_on(empty)).count() == 0 and drop_rejected(empty).columns == empty.columns


def test_subwords_stay_within_texts():
    grams, owner = subwords(["ab", "", "1", "cd ef"])
    assert set(owner.tolist()) == {0, 3} and len(grams) == len(owner)
    one, _ = subwords(["cd ef"])
    assert sorted(grams[owner == 3].tolist()) == sorted(one.tolist())


def test_scores_are_plain_averages_under_a_softmax(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit_on(docs)
    for row in predict(docs, model).select("text", "lang_pred", "score").collect():
        grams = subwords([row["text"]])[0].tolist() if row["text"] else []
        if row["lang_pred"] == "und":
            assert row["score"] == 0
            continue
        logits = [(sum(float(model.scores[c][g]) for g in grams) / len(grams) + model.bias[c]) / model.temperature for c in range(len(model.languages))]
        whole = sum(math.exp(x - max(logits)) for x in logits)
        assert abs(row["score"] - 1 / whole) < 1e-9
        assert row["lang_pred"] == model.languages[logits.index(max(logits))]


FOREIGN = ["Съешь ещё этих мягких французских булок да выпей чаю", "これは日本語の文章です。今日はとても良い天気ですね", "Pójdźże kiń tę chmurność w głąb flaszy i nie zwlekaj"]


def test_texts_of_no_known_language_are_rejected_and_clean_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null")
    model = fit_on(docs)
    assert model.caught > 0.9 and 0 < model.least_known < 1
    rng = random.Random(3)
    texts = [r["text"] for r in docs.filter("length(text) > 200").orderBy("doc_id").limit(200).collect()]
    shuffled = ["".join(rng.sample(t, len(t))) for t in texts]
    rows = [(i, t, "no") for i, t in enumerate(FOREIGN + shuffled)]
    found = predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model)
    assert found.filter("rejected").count() > 0.97 * len(rows) and found.filter(f"doc_id < {len(FOREIGN)} and not rejected").count() == 0
    # Whole texts of the corpus, seen or not, and texts half in one language, half in another.
    kept = predict(docs, model).filter("not rejected")
    assert kept.count() >= 0.998 * docs.count()
    by = {lang: [r["text"] for r in docs.filter(held_out(F.col("doc_id")) & (F.col("lang") == lang)).orderBy("doc_id").collect()] for lang in model.languages}
    mixed = [(k, f"{a[:300]} {b[:300]}") for k, (a, b) in enumerate((a, b) for x in by for y in by if x < y for a, b in zip(by[x], by[y]))]
    stay = predict(spark.createDataFrame(mixed, "doc_id long, text string"), model).filter("not rejected").count()
    assert len(mixed) > 20 and stay >= 0.98 * len(mixed)


def test_negatives_hold_letters_only_of_their_text():
    rng = np.random.default_rng(0)
    for text in ("", "1 2", "abc abd ab", "Ärger mit Ö"):
        for _ in range(4):
            assert len(negative(text, rng)) == len(text) and set(negative(text, rng).lower()) <= set(text.lower())


def test_rejected_rows_go_with_their_own_columns_kept(spark):
    clean = [(i, "the and of in that with for this", "en", "x") for i in range(30)] + [(99, "ыйц жэх юбф", None, "y"), (100, None, "en", "z"), (5, "the and of in that with for this", "en", "x")]
    docs = spark.createDataFrame(clean, "doc_id long, text string, lang string, rejected string").withColumn("lang_pred", F.lit("own"))
    kept = drop_rejected(docs)
    assert kept.columns == ["doc_id", "text", "lang", "rejected", "lang_pred"]
    got = kept.collect()
    assert len(got) == 31 and {r["rejected"] for r in got} == {"x"} and {r["lang_pred"] for r in got} == {"own"}
