"""Numbered grams, vectors made by joins, training to a table, and the search that shares its features."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from cuewright.ml import encoding, linear, model, search


def grams(text, lo, hi):
    return [text[i:i + n] for n in range(lo, hi + 1) for i in range(len(text) - n + 1)]


def texts(n, seed):
    """Rows of two classes that share some words."""
    rng = random.Random(seed)
    words = "visit our site now subscribe the a house went home river stone".split()
    return [(i, " ".join(rng.choices(words[:6] if i % 3 == 0 else words[4:], k=rng.randint(1, 9))), int(i % 3 == 0)) for i in range(n)]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(texts(240, 7), "id BIGINT, clean_text STRING, label INT").select("clean_text", "label").cache()


@pytest.mark.parametrize("n, parts", [(0, 1), (1, 3), (1000, 1), (1000, 7)])
def test_numbers_are_dense_and_in_order(spark, n, parts):
    values = random.Random(n).sample(range(10 * n + 1), n)
    df = spark.createDataFrame([(v, str(v)) for v in values], "v BIGINT, s STRING").repartition(parts)
    found = encoding.numbered(df, F.desc("v")).collect()
    assert {r.v: r.idx for r in found} == {v: i for i, v in enumerate(sorted(values, reverse=True))} and len(found) == n


@pytest.mark.parametrize("sublinear", [False, True])
@pytest.mark.parametrize("size", [None, 5])
def test_vectors(spark, sublinear, size):
    """Against TF-IDF in Python, with a null, an empty, a short, a repeated and a very long text."""
    given = ["the home page", "the home page", "", "ab", None, "visit the home\n\n now ", "xyz", "the river " * 30_000]
    rows = spark.createDataFrame(list(enumerate(given)), "k INT, clean_text STRING").withColumn("gram", F.lit("extra"))
    counts = encoding.text_gram_counts(rows, ["k"], 3, 4)
    numbers = encoding.dictionary(encoding.frequencies(counts), size)
    vocabulary = {r.gram: r.idx for r in numbers.collect()}
    weighted = encoding.weights(counts, numbers, len(given), "k", sublinear)
    found = {r.k: r.features for r in encoding.feature_table(rows, "k", weighted, len(vocabulary), ["k"]).collect()}
    prepared = ["" if t is None else t.replace("\n\n ", "\n\n").replace("\n\n", " ") for t in given]
    in_texts = [Counter(grams(t, 3, 4)) for t in prepared]
    total, df = Counter(), Counter()
    for c in in_texts:
        total.update(c)
        df.update(c.keys())
    expected_order = sorted(total, key=lambda g: (-total[g], g.encode()))[:size]
    assert vocabulary == {g: i for i, g in enumerate(expected_order)}
    for k, c in enumerate(in_texts):
        raw = {vocabulary[g]: (1 + math.log(tf) if sublinear else tf) * (math.log((1 + len(given)) / (1 + df[g])) + 1) for g, tf in c.items() if g in vocabulary}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        assert isinstance(found[k], SparseVector) and found[k].size == len(vocabulary)
        assert dict(zip(found[k].indices, found[k].values)) == pytest.approx({i: w / norm for i, w in raw.items()})


@pytest.mark.parametrize("preset, more", [("best", {}), ("best", {"sublinear": True, "vocabSize": 90}), ("plain", {})])
def test_table_is_the_pipeline(spark, samples, preset, more):
    """Trained to a table, the model gives the scores of the pipeline; preset ``plain`` has all grams."""
    expected = model.score(samples, model.train(samples, preset, maxIter=100, **more))
    table = linear.train_table(samples, preset, maxIter=100, **more)
    assert table.grams.columns == ["gram", "idf", "coefficient"]
    found = linear.linear_scores(samples.distinct(), ["clean_text", "label"], table)
    both = found.join(expected.select("clean_text", "label", F.col("score").alias("of_pipeline")).distinct(), ["clean_text", "label"])
    assert both.count() >= found.count() and both.filter("abs(score - of_pipeline) > 1e-4").count() == 0


def test_table_needs_grams_and_bounds_rows(spark, samples):
    with pytest.raises(ValueError):
        linear.train_table(spark.createDataFrame([("ab", 0), (None, 1)], "clean_text STRING, label INT"))
    small = linear.train_table(samples, maxRows=30, maxIter=5)
    every = linear.train_table(samples, maxIter=5)
    assert 0 < small.grams.count() < every.grams.count()


def test_fold_frequencies(spark):
    rng = random.Random(3)
    rows = [(k, k % 3, " ".join(rng.choices("river stone home".split(), k=3))) for k in range(40)]
    counts = encoding.text_gram_counts(spark.createDataFrame(rows, "k INT, fold INT, clean_text STRING"), ["k", "fold"], 3, 3)
    of_folds = search.fold_frequencies(counts, 3).cache()
    for k in range(3):
        n, df = Counter(), Counter()
        for _, fold, t in rows:
            if fold != k:
                n.update(grams(t, 3, 3))
                df.update(set(grams(t, 3, 3)))
        assert {r.gram: (r.n, r.df) for r in search.without_fold(of_folds, k).collect()} == {g: (n[g], df[g]) for g in n}


def test_shared_search_is_the_search(samples):
    """Every mean AUC is the cross-validator's, for penalties of both kinds, two ranges, a cap and both term weights."""
    grid = {"C": [5.0], "penalty": ["l2", "l1"], "ngrams": [(3, 3), (3, 4)], "sublinear": [True]}
    fixed = {"vocabSize": 60, "maxIter": 15}
    _, expected = search.grid_search(samples, grid, folds=2, **fixed)
    found = search.shared_search(samples, grid, folds=2, **fixed)
    expected, found = ({r.setting: r.auc for r in t.collect()} for t in (expected, found))
    assert len(found) == 4 and found == pytest.approx(expected, abs=2e-3)
    with pytest.raises(ValueError):
        search.shared_search(samples, {"solver": ["saga"]})



def test_grams_of_short_texts_are_not_shuffled(spark, monkeypatch):
    """Counts as in plain Python on both sides of the length from which texts are cut, and no exchange of occurrences below it."""
    from collections import Counter

    from cuewright.ml import features

    texts = ["abcabc", "", None, "ab", "AAAA aaa", "x y  z\n\nx y", "é😀é😀é😀", "abcd" * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "id INT, clean_text STRING")
    monkeypatch.setattr(features, "SHORT", 12)
    def grams(text):
        text = re.sub(r"\s{2,}", " ", text.lower())
        return Counter(text[i:i + n] for n in (3, 4) for i in range(len(text) - n + 1))
    got = {(r.id, r.gram): r.tf for r in features.text_grams(docs, 3, 4, ["id"]).collect()}
    assert got == {(i, g): n for i, t in enumerate(texts) for g, n in grams(t or "").items()}
    monkeypatch.undo()
    short = features.text_grams(docs.filter("id < 7"), 3, 4, ["id"])
    assert {(r.id, r.gram): r.tf for r in short.collect()} == {k: n for k, n in got.items() if k[0] < 7}
    plan = short._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # that of long texts
