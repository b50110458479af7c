import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuewright.functions import ngrams as N
from cuewright.ml import evaluate as E
from cuewright.ml import features as X
from cuewright.ml import model as M
from cuewright.ml.search import grid_search
from cuewright.operators.detect import detect_model, mark


def grams(text, lo, hi):
    return [text[i:i + n] for n in range(lo, hi + 1) for i in range(len(text) - n + 1)]


TEXTS = ["abcd", "AB  c\n\nd", "ab", "", "𝒳y𝒵w é\U00020000z", "a b\tc"]


def test_char_ngrams(apply):
    prepared = ["abcd", "ab c d", "ab", "", "𝒳y𝒵w é\U00020000z", "a b\tc"]
    assert apply(lambda c: N.char_ngrams(c, 3, 4), TEXTS) == [grams(t, 3, 4) for t in prepared]


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_pieces_have_the_grams_of_the_text(apply, size):
    texts = ["".join(random.Random(i).choice("abé𝒳") for _ in range(i)) for i in range(30)]
    def cut(c):
        return F.flatten(F.transform(N.text_pieces(c, 4, size), lambda p: N.piece_ngrams(p, 3, 4, size)))
    got = apply(cut, texts)
    assert [Counter(g) for g in got] == [Counter(grams(t, 3, 4)) for t in texts]


def python_tfidf(texts, lo, hi, sublinear=False):
    counts = [Counter(grams(t, lo, hi)) for t in texts]
    df = Counter(g for c in counts for g in c)
    out = {}
    for i, c in enumerate(counts):
        w = {g: ((1 + math.log(n)) if sublinear else n) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.update({(i, g): v / norm for g, v in w.items()})
    return out


@pytest.mark.parametrize("sublinear", [False, True])
def test_tfidf_rows_and_vectors(spark, sublinear):
    texts = ["the cat sat", "the dog sat on the cat", "xyz", "", "aaaaaaaa"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, clean_text STRING")
    expected = python_tfidf(texts, 3, 4, sublinear)
    rows = {(r.id, r.gram): r.weight for r in X.tfidf_rows(df, "id", 3, 4, sublinear).collect()}
    assert rows.keys() == expected.keys()
    assert all(abs(rows[k] - expected[k]) < 1e-12 for k in rows)
    fitted = X.fit_tfidf(df, 3, 4, 1000, sublinear)
    vocab = fitted.stages[1].vocabulary
    for r in fitted.transform(df).collect():
        got = {(r.id, vocab[i]): v for i, v in zip(r.features.indices, r.features.values)}
        assert all(abs(got[k] - expected[k]) < 1e-12 for k in got)
        assert len(got) == sum(k[0] == r.id for k in expected)


def test_idf_literals(spark):
    df = spark.createDataFrame([(1,), (2,), (4,)], "df INT")
    assert [round(r[0], 6) for r in df.select(X.idf(F.lit(4), F.col("df"))).collect()] == [1.916291, 1.510826, 1.0]


def test_vocabulary_cap_and_ties(spark):
    df = spark.createDataFrame([("abcabc",), ("abc",), ("zzzy",)], "clean_text STRING")
    assert [(r.gram, r.n) for r in X.vocabulary(df, 3, 3, 3).collect()] == [("abc", 3), ("bca", 1), ("cab", 1)]


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(1)
    words = "the a of sea boat runs green stone light".split()
    rows = [(" ".join(rng.choices(words, k=6)) + (" join our channel now" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    return spark.createDataFrame(sorted(set(rows)), "clean_text STRING, label INT").cache()


def test_training_reaches_the_optimum(spark, samples):
    import numpy as np

    model = M.train(samples, C=1.0, vocabSize=300)
    rows = model.transform(samples).select("features", "label").collect()
    regression = model.stages[-1]
    beta, n = regression.coefficients.toArray(), len(rows)
    of_class = Counter(r.label for r in rows)
    gradient = beta.copy()
    for r in rows:
        z = r.features.dot(beta) + regression.intercept
        gradient += n / (2 * of_class[r.label]) * (1 / (1 + math.exp(-z)) - r.label) * r.features.toArray()
    assert np.abs(gradient).max() < 1e-2


def test_score_save_load_detect(spark, samples, tmp_path):
    model = M.train(samples, vocabSize=300, maxIter=50)
    scored = M.score(samples, model)
    report = {r["class"]: r for r in E.classification_report(scored).collect()}
    assert report["accuracy"].precision > 0.95
    assert M.load_model(str(tmp_path / "none")) == (None, 0.5)
    path = str(tmp_path / "m")
    M.save_model(model, path)
    assert M.load_model(path)[1] == 0.5
    M.save_model(model, path, 0.37)
    loaded, threshold = M.load_model(path)
    assert threshold == 0.37
    same = M.score(samples, loaded).select("clean_text", F.col("score").alias("again")).join(scored, "clean_text")
    assert same.filter("abs(score - again) > 1e-12").count() == 0
    cues = samples.select(F.lit("p").alias("path"), F.lit(0).alias("pos"), F.col("clean_text").alias("text"), "label")
    found = detect_model(cues, loaded, threshold)
    assert found.columns == ["path", "pos", "text", "label", "score"]
    assert found.count() == scored.filter("score >= 0.37").count()
    assert mark(cues, loaded, use_model=False).filter("is_ad").count() == cues.filter("label = 1").count()


def test_train_and_evaluate(spark, samples, tmp_path):
    from cuewright.plans.training import samples_from_lines, train_and_evaluate

    lines = lambda label: samples.filter(F.col("label") == label).select(F.col("clean_text").alias("text"))
    both = samples_from_lines(lines(1), lines(0))
    assert both.count() == samples.filter("length(clean_text) >= 15").count()
    done = train_and_evaluate(both, path=str(tmp_path / "m"), vocabSize=200, maxIter=20)
    assert M.load_model(str(tmp_path / "m"))[1] == done.threshold == done.tuned.first().threshold
    assert done.tuned.first().recall >= 0.95 and done.auc.first().auc > 0.9
    assert done.report.count() == done.tuned_report.count() == 5


def test_short_text_scores_the_intercept(spark, samples):
    model = M.train(samples, vocabSize=100, maxIter=20)
    score = M.score(spark.createDataFrame([("ab",)], "clean_text STRING"), model).first().score
    assert abs(score - 1 / (1 + math.exp(-model.stages[-1].intercept))) < 1e-12


def test_sublinear_model_and_search(spark, samples):
    model = M.train(samples, vocabSize=100, maxIter=10, sublinear=True)
    assert M.score(samples, model).count() == samples.count()
    search, table = grid_search(samples, {"C": [0.1, 5.0], "ngrams": [(3, 3)]}, folds=2, vocabSize=100, maxIter=5)
    rows = table.collect()
    assert len(rows) == 2 and all(r.auc > 0.9 for r in rows)
    with pytest.raises(ValueError):
        grid_search(samples, {"solver": ["saga"]})


def test_registered_search_covers_ngrams(monkeypatch):
    """Both n-gram ranges with both penalties, all else as preset."""
    from catalog import spark_queries

    asked = {}
    monkeypatch.setattr(spark_queries.D, "samples", lambda spark, sf: None)
    monkeypatch.setattr(spark_queries.search, "grid_search", lambda samples, grid, **settings: (None, asked.update(grid=grid, settings=settings)))
    spark_queries.Q["grid_search"](None, "")
    assert asked == {"grid": {"C": [1.0, 5.0], "ngrams": [(3, 3), (3, 4)]}, "settings": {}}


def predictions(spark, rows):
    return spark.createDataFrame(rows, "label INT, score DOUBLE").withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


def test_report_literals(spark):
    rows = [(0, 0.1)] * 602 + [(1, 0.1)] * 6 + [(1, 0.9)] * 92
    pred = predictions(spark, rows)
    assert sorted(map(tuple, E.confusion_matrix(pred).collect())) == [(0, 602, 0), (1, 6, 92)]
    report = {r["class"]: r for r in E.classification_report(pred).collect()}
    assert report["accuracy"].f1 == 694 / 700 and report["1"].precision == 1.0 and report["1"].recall == 92 / 98
    assert report["0"].precision == 602 / 608 and report["0"].support == 602
    shown = [round(report["macro avg"][k], 2) for k in ("precision", "recall", "f1")]
    assert shown == [1.0, 0.97, 0.98]


def test_threshold_literal(spark):
    pred = predictions(spark, [(1, i / 100) for i in range(1, 99)] + [(0, 0.051)])
    best = E.threshold_for_recall(pred, 0.95).first()
    assert best.threshold == 0.05 and best.recall == 94 / 98 and best.precision == 94 / 95


@pytest.mark.parametrize("distinct", [1, 3, 50, 5000])
def test_curve_and_auc_against_brute_force(spark, distinct):
    rng = random.Random(distinct)
    rows = [(int(rng.random() < 0.3), rng.randrange(distinct) / distinct) for _ in range(3000)]
    pos, neg = [s for l, s in rows if l], [s for l, s in rows if not l]
    pred = predictions(spark, rows)
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(E.roc_auc(pred).first().auc - auc) < 1e-9
    for r in E.score_curve(pred).collect()[:200]:
        assert r.tp == sum(p >= r.score for p in pos) and r.fp == sum(n >= r.score for n in neg)
    best = E.threshold_for_recall(pred, 0.9).first()
    assert best.threshold == sorted(pos, reverse=True)[math.ceil(0.9 * len(pos) - 1e-9) - 1]


def test_single_class(spark):
    pred = predictions(spark, [(0, 0.2), (0, 0.7)])
    assert E.roc_auc(pred).first().auc is None
    assert E.threshold_for_recall(pred).count() == 0
