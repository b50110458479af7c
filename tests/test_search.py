"""Training, scoring and search by batches against MLlib's own stages."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from cuewright.ml import features, model, search
from cuewright.operators import detect


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(5)
    words = "the a of sea boat runs green stone light join our channel now".split()
    rows = [(" ".join(rng.choices(words[3:] if i % 4 == 0 else words[:10], k=rng.randint(2, 7))), int(i % 4 == 0)) for i in range(160)]
    return spark.createDataFrame(sorted(set(rows)), "clean_text STRING, label INT").cache()


def test_search_is_that_of_the_cross_validator(samples):
    """Means of folds, the best setting and its model; TF-IDF is fitted once for both ``C``."""
    grid, settings = {"C": [0.1, 5.0], "ngrams": [(2, 3), (3, 3)]}, {"vocabSize": 60, "maxIter": 8}
    estimator = model.AdClassifier(**settings)
    plain = CrossValidator(
        estimator=estimator, estimatorParamMaps=search.param_maps(estimator, grid), numFolds=3, foldCol="fold",
        evaluator=BinaryClassificationEvaluator(labelCol="label", numBins=0),
    ).fit(search.with_fold(samples, 3).withColumn("label", F.col("label").cast("double")))
    found, table = search.grid_search(samples, grid, **settings)
    assert found.avgMetrics == pytest.approx(plain.avgMetrics, abs=1e-9)
    assert [r.auc for r in table.collect()] == found.avgMetrics
    assert found.bestModel.stages[1].vocabulary == plain.bestModel.stages[1].vocabulary
    assert found.bestModel.stages[-1].coefficients.toArray() == pytest.approx(plain.bestModel.stages[-1].coefficients.toArray(), abs=1e-9)


def test_tfidf_once_for_all_penalties(samples, monkeypatch):
    fitted = []
    monkeypatch.setattr(search, "fit_tfidf", lambda *a: fitted.append(a[1:]) or features.fit_tfidf(*a))
    search.grid_search(samples, {"C": [0.1, 1.0, 5.0]}, folds=2, vocabSize=40, maxIter=3)
    assert fitted == [(3, 4, 40, False)] * 2


def test_a_fold_without_samples(spark):
    one = spark.createDataFrame([("a text", 1)] * 3, "clean_text STRING, label INT")
    with pytest.raises(ValueError, match="fold"):
        search.grid_search(one, {"C": [1.0]}, vocabSize=10)


@pytest.mark.parametrize("sublinear", [False, True])
def test_vectors_and_scores_are_those_of_the_stages(spark, samples, monkeypatch, sublinear):
    fitted = model.train(samples, vocabSize=80, maxIter=10, sublinear=sublinear)
    rows = samples.union(spark.createDataFrame([("", 0), ("ab", 0), ("QQQ  zz", 1), ("Join  our\n\nchannel now", 1)], samples.schema))
    expected = {r.clean_text: r for r in fitted.transform(rows).select("*", vector_to_array("probability")[1].alias("score")).collect()}
    for r in features.vectors(rows, features.PipelineModel(fitted.stages[:-1]), ["clean_text"]).collect():
        plain = expected[r.clean_text].features.toArray()
        assert r.features.toArray() == pytest.approx(plain, abs=1e-12)
    monkeypatch.setattr(type(fitted), "transform", None)  # no array of grams for a text
    for r in model.score(rows, fitted).collect():
        assert r.score == pytest.approx(expected[r.clean_text].score, abs=1e-12) and r.prediction == expected[r.clean_text].prediction
    cues = rows.select(F.col("clean_text").alias("text"))
    marked = detect.mark_model(cues.union(spark.createDataFrame([(None,)], "text STRING")), fitted, 0.3)
    assert marked.columns == ["text", "score", "is_ad"] and marked.count() == rows.count() + 1
    plan = marked.filter("is_ad")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_counts_shuffle_no_occurrence(spark):
    """A row a gram and part, not one an occurrence."""
    texts = spark.createDataFrame([("ab" * 50,)] * 40, "clean_text STRING").coalesce(1)
    counted = features.gram_frequencies(texts, 3, 4)
    assert sorted(map(tuple, counted.collect())) == [("aba", 40 * 49, 40), ("abab", 40 * 49, 40), ("bab", 40 * 49, 40), ("baba", 40 * 48, 40)]
    assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()


class _Seen(Exception):
    pass


@pytest.fixture
def rows_fitted(monkeypatch):
    """Stops before the fit and tells how many rows it was to have."""
    def seen(texts, *a):
        raise _Seen(texts.count())
    monkeypatch.setattr(model, "fit_tfidf", seen)
    monkeypatch.setattr(search, "fit_tfidf", seen)


def _many(spark, n):
    return spark.range(n).select(F.concat(F.lit("text "), "id").alias("clean_text"), (F.col("id") % 5 == 0).cast("int").alias("label"))


@pytest.mark.parametrize("preset", ["best", "plain"])
def test_all_labelled_rows_are_trained_on(spark, rows_fitted, preset):
    """Also more than 200,000, which once were the most that were taken."""
    with pytest.raises(_Seen, match="^200100$"):
        model.train(_many(spark, 200_100), preset)


def test_a_fold_is_trained_on_all_rows_outside(spark, rows_fitted):
    rows = _many(spark, 410_000)
    outside = search.with_fold(rows, 2).filter("fold <> 0").count()
    assert outside > 200_000
    with pytest.raises(_Seen, match=f"^{outside}$"):
        search.grid_search(rows, {"C": [1.0]}, folds=2)


@pytest.mark.parametrize("name", ["clean_by_model", "detect_model", "train_score"])
def test_registered_training_takes_all_rows(spark, monkeypatch, name):
    """No query gives a bound of its own."""
    from catalog import spark_queries

    def seen(samples, *a, **settings):
        raise _Seen(model.AdClassifier(**{**model.PRESETS["best"], **settings}).getOrDefault("maxRows"))
    monkeypatch.setattr(spark_queries.model, "train", seen)
    with pytest.raises(_Seen, match="^0$"):
        spark_queries.Q[name](spark, "/root/testdata/sf0.001")


def test_no_task_holds_more_than_a_split_of_the_features(spark, samples, monkeypatch):
    """However many tasks are asked for."""
    taken = []
    monkeypatch.setattr(model.LogisticRegression, "fit", lambda self, rows: taken.append(rows.rdd.getNumPartitions()))
    stored = features.vectors(samples.repartition(6), features.fit_tfidf(samples, 3, 3, 60), ["label"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            model.regress(stored, 1.0, partitions=1)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert taken[0] == 1 and taken[1] >= 6
