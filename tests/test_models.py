import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from corpuscat.operators import bayes, evaluate, labels, linear, split
from corpuscat.plans.catalog import QUERIES, models
from corpuscat.plans.training import train_bayes
from corpuscat.sources.tables import table
from conftest import SF

TEXTS = [("good fun film", 0), ("fun fun", 0), ("bad dull film", 1), ("dull plot", 1), ("odd", 2)]
ASKED = [("fun film", 0), ("dull dull words", 1), ("", 2), ("unseen", 0), ("odd film", 2)]


def brute_force(alpha):
    counts, docs = {}, Counter(y for _, y in TEXTS)
    for t, y in TEXTS:
        counts.setdefault(y, Counter()).update(t.split())
    vocab = set().union(*counts.values())
    out = []
    for t, y in ASKED:
        scores = [
            math.log(docs[c] / len(TEXTS))
            + sum(math.log((counts[c][w] + alpha) / (sum(counts[c].values()) + alpha * len(vocab))) for w in t.split() if w in vocab)
            for c in sorted(docs)
        ]
        best = max(range(len(scores)), key=lambda c: (round(scores[c], 6), -c))
        out.append((y, best, scores[best], math.log(sum(map(math.exp, scores))) - scores[y]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "i int, t string, y int")


def test_bayes_equals_brute_force(spark, tmp_path):
    model = bayes.fit_bayes(frame(spark, TEXTS), "t", "y")
    model.save(str(tmp_path))
    model = bayes.BayesModel.load(spark, str(tmp_path))
    got = bayes.bayes_predict(frame(spark, ASKED), "i", "t", "y", model, [1.0, 0.5]).collect()
    for candidate, alpha in enumerate((1.0, 0.5)):
        rows = sorted((r for r in got if r["candidate"] == candidate), key=lambda r: r["i"])
        for r, (y, best, score, loss) in zip(rows, brute_force(alpha), strict=True):
            assert (r["label"], r["prediction"], r["alpha"]) == (y, best, alpha)
            assert r["score"] == pytest.approx(score) and r["loss"] == pytest.approx(loss)


def test_many_classes(spark):
    """3,000 classes of random words: predictions, scores and losses of plain sums over all classes."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(400)])
    made = [(" ".join(words[np.minimum(rng.geometric(0.01, int(rng.integers(0, 30))) - 1, 399)]), int(y)) for y in rng.integers(0, 3_000, 9_000)]
    train, asked = made[:8_800], made[8_800:] + [("", 17), ("nowhere", 2_999), ("w1", 5_000)]
    alphas = [1.0, 0.1]
    model = bayes.fit_bayes(frame(spark, train), "t", "y")
    got = {(r["i"], r["candidate"]): r for r in bayes.bayes_predict(frame(spark, asked), "i", "t", "y", model, alphas).collect()}
    plain = {r["i"]: r for r in bayes.bayes_predict(frame(spark, asked), "i", "t", "y", model, alphas[:1], loss=False).collect()}
    labels_ = sorted({y for _, y in train})
    index = {w: i for i, w in enumerate(sorted({w for t, _ in train for w in t.split()}))}
    n = np.zeros((len(labels_), len(index)))
    place = {y: i for i, y in enumerate(labels_)}
    docs = np.zeros(len(labels_))
    for t, y in train:
        docs[place[y]] += 1
        for w in t.split():
            n[place[y], index[w]] += 1
    assert len(got) == 2 * len(asked)
    for candidate, a in enumerate(alphas):
        log = np.log((n + a) / (n.sum(axis=1, keepdims=True) + a * len(index)))
        for i, (t, y) in enumerate(asked):
            score = np.log(docs / docs.sum()) + sum((log[:, index[w]] for w in t.split() if w in index), np.zeros(len(labels_)))
            r = got[i, candidate]
            assert r["score"] == pytest.approx(score.max(), abs=1e-7)
            assert score[place[r["prediction"]]] == pytest.approx(score.max(), abs=1e-7)
            if y in place:
                assert r["loss"] == pytest.approx(np.log(np.exp(score - score.max()).sum()) + score.max() - score[place[y]], abs=1e-6)
            else:
                assert r["loss"] is None
            if not candidate:
                assert (plain[i]["prediction"], plain[i]["score"], plain[i]["loss"]) == (r["prediction"], r["score"], None)


def test_upper_lines():
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 200):
        start, step = -rng.random(size) * 10, -rng.random(size)
        start[size // 2], step[size // 2] = start[0], step[0]
        at, low, high = bayes.upper_lines(start, step)
        assert low[0] == 0 and (low[1:] == high[:-1]).all() and high[-1] == np.inf
        for x in range(60):
            on = at[(low <= x) & (x <= high)]
            assert (start[on] + x * step[on]).max() == pytest.approx((start + x * step).max())


def test_metrics_with_a_class_never_predicted(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (2, 1), (1, 1), (3, 0)]
    counts = evaluate.confusion(spark.createDataFrame(pairs, "label bigint, prediction bigint"))
    per = {r["label"]: r for r in evaluate.per_class(counts).collect()}
    for c in range(4):
        tp = sum(y == p == c for y, p in pairs)
        fp = sum(p == c != y for y, p in pairs)
        fn = sum(y == c != p for y, p in pairs)
        assert (per[c]["tp"], per[c]["fp"], per[c]["fn"]) == (tp, fp, fn)
        assert per[c]["precision"] == pytest.approx(tp / (tp + fp) if tp + fp else 0)
        assert per[c]["recall"] == pytest.approx(tp / (tp + fn) if tp + fn else 0)
        assert per[c]["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
    m = evaluate.metrics(counts).first()
    assert m["accuracy"] == m["micro_f1"] == m["micro_precision"] == m["micro_recall"] == pytest.approx(0.5)
    assert m["macro_f1"] == pytest.approx(sum(r["f1"] for r in per.values()) / 4)
    wide = evaluate.confusion_wide(spark.createDataFrame(pairs, "label bigint, prediction bigint"), [0, 1, 2, 3])
    assert tuple(wide.orderBy("label").first()) == (0, 1, 1, 0, 0)


def test_first_candidate_wins_a_tie(spark):
    hist = spark.createDataFrame([(1, 0.5), (0, 0.5), (2, 0.4)], "candidate int, micro_f1 double")
    assert evaluate.select_best(hist).first()["candidate"] == 0
    assert evaluate.long_series(hist, ["candidate"]).count() == 3


def test_linear_models_save_and_load(spark, tmp_path):
    emb = table(spark, SF, "embeddings").select(F.col("vec_id").alias("i"), "embedding", F.col("label").cast("bigint").alias("label"))
    rows = linear.with_vector(split.split_80_10_10(emb, "label", "i"), "embedding").cache()
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    model, hist = linear.fit_candidates(train, val, [linear.vector_regression(r, 5) for r in (0.0, 0.3)], "i")
    assert hist.count() == 2
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = ({r["i"]: r["prediction"] for r in linear.predict(m, val, "i").collect()} for m in (model, again))
    assert a == b and len(a) == val.count()


def test_word_regression_learns(spark):
    rows = linear.with_words(frame(spark, TEXTS * 4).withColumnRenamed("y", "label"), "t")
    model = linear.word_regression(num_features=64).fit(rows)
    got = linear.predict(model, rows, "i")
    assert got.filter("label != prediction").count() == 0 and got.agg(F.max("loss")).first()[0] < 0.7


def test_training_run(spark, tmp_path):
    docs = table(spark, SF, "documents").select(F.col("doc_id").alias("i"), "text", F.col("lang").alias("category"))
    index = labels.label_index(docs, "category")
    rows = split.split_64_16_20(labels.attach_label(docs, "category", index), "label", "i").cache()
    report = train_bayes(rows, "i", "text", str(tmp_path), index).first()
    assert report["max_length"] == 512 and report["num_labels"] == index.count() and report["test_metrics"]["accuracy"] > 0.8
    assert spark.read.parquet(str(tmp_path / "history")).count() == 3
    assert spark.read.parquet(str(tmp_path / "labels")).count() == report["num_labels"]


def test_words_are_looked_up_where_they_are(spark, monkeypatch):
    """The words of texts go to the model's terms without a shuffle before."""
    seen, plain = [], bayes.lookup

    def kept(rows, table, key, *a, **k):
        seen.extend([rows._jdf.queryExecution().executedPlan().toString()] if key == "token" else [])
        return plain(rows, table, key, *a, **k)

    monkeypatch.setattr(bayes, "lookup", kept)
    model = bayes.fit_bayes(frame(spark, TEXTS), "t", "y")
    bayes.bayes_predict(frame(spark, ASKED), "i", "t", "y", model)
    assert len(seen) == 1 and "hashpartitioning" not in seen[0] and "regexp_extract" not in seen[0]


@pytest.mark.parametrize("name,stores", [("lr_text", 1), ("train_run", 1)])
def test_words_of_a_run_are_stored_once(spark, monkeypatch, name, stores):
    seen, plain = [], models.cut_lineage

    def kept(df):
        seen.extend([1] if "words" in df.columns else [])
        return plain(df)

    monkeypatch.setattr(models, "cut_lineage", kept)
    QUERIES[name](spark, SF).count()
    assert len(seen) == stores


@pytest.mark.parametrize("top", [2, 15, 16, 40])
def test_a_block_has_no_more_numbers_than_labels(spark, monkeypatch, top):
    """Few labels: one grouping of the words, and sums of as many numbers as labels; the counts are those of the texts."""
    rows = [(t, top if y == 2 else y) for t, y in TEXTS] + [("good odd", top)]
    plans, plain = [], bayes.cut_lineage

    def kept(df):
        plans.extend([df._jdf.queryExecution().executedPlan().toString()] if "blocks" in df.columns else [])
        return plain(df)

    monkeypatch.setattr(bayes, "cut_lineage", kept)
    model = bayes.fit_bayes(frame(spark, rows), "t", "y")
    got = {(r["token"], r["block"] * bayes.BLOCK + i): n for r in model.terms.select("token", F.inline("blocks")).collect() for i, n in enumerate(r["counts"]) if n}
    assert got == Counter((w, y) for t, y in rows for w in t.split())
    assert {len(r["counts"]) for r in model.terms.select(F.inline("blocks")).collect()} == {min(bayes.BLOCK, top + 1)}
    assert ("collect_list" not in plans[0]) == (top < bayes.BLOCK)
    asked = bayes.bayes_predict(frame(spark, [("odd", top), ("dull", 1), ("fun", top + 1)]), "i", "t", "y", model, [1.0, 0.5])
    found = {(r["i"], r["candidate"]): (r["prediction"], r["loss"] is None) for r in asked.collect()}
    assert found == {(i, c): (p, i == 2) for i, p in enumerate((top, 1, 0)) for c in (0, 1)}


def test_labels_that_are_null_or_absent(spark):
    """Rows without a label count as before: their words are in the vocabulary, and go into no label's counts."""
    rows = spark.createDataFrame([(0, "a b", 0), (1, "a c", 1), (2, "a d", None)], "i int, t string, y int")
    model = bayes.fit_bayes(rows, "t", "y")
    counts = {r["token"]: (r["n"], sorted(tuple(c for c in b["counts"] if c) for b in r["blocks"])) for r in model.terms.collect()}
    assert counts == {"a": (3, [(), (1, 1)]), "b": (1, [(1,)]), "c": (1, [(1,)]), "d": (1, [()])}
    none = bayes.fit_bayes(rows.limit(0), "t", "y")
    assert none.terms.count() == none.classes.count() == 0
