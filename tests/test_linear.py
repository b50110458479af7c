"""The classifier as a table, and the choice of rows to train on."""

import random

import pytest
from pyspark.sql import functions as F

from cuewright.ml import linear, model
from cuewright.operators import detect
from cuewright.operators.sampling import least_by_hash


def texts(n, seed=1):
    rng = random.Random(seed)
    words = "visit our site now subscribe the a house went home river stone".split()
    rows = []
    for i in range(n):
        label = i % 3 == 0
        rows.append((i, " ".join(rng.choices(words[:6] if label else words[4:], k=rng.randint(1, 9))), int(label)))
    return rows


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(texts(300), "id BIGINT, clean_text STRING, label INT").cache()


@pytest.mark.parametrize("sublinear", [False, True])
def test_scores_of_the_pipeline(spark, samples, tmp_path, sublinear):
    """Scores by the stored table are those of the fitted pipeline."""
    fitted = model.train(samples, sublinear=sublinear, vocabSize=200, maxIter=30)
    linear.save_table(linear.to_table(fitted, 0.4), str(tmp_path))
    table = linear.load_table(spark, str(tmp_path))
    assert (table.lo, table.hi, table.sublinear, table.threshold) == (3, 4, sublinear, 0.4)
    odd = [(1_000, None, 0), (1_001, "", 0), (1_002, "ab", 0), (1_003, "zzzz qqqq", 0), (1_004, "visit\n\n our SITE " * 20_000, 1)]
    rows = samples.union(spark.createDataFrame(odd, samples.schema))
    expected = {r.id: r.score for r in model.score(rows.filter("clean_text IS NOT NULL"), fitted).collect()}
    found = linear.linear_scores(rows.withColumn("score_of", F.lit(1)), ["id"], table).collect()
    assert len(found) == 305 and found[0].score_of == 1
    by_id = {r.id: r.score for r in found}
    assert all(by_id[i] == pytest.approx(s, abs=1e-9) for i, s in expected.items())
    assert by_id[1_000] == by_id[1_001] == by_id[1_003]  # the intercept alone
    cues = samples.select(F.lit("f").alias("path"), F.col("id").alias("pos"), F.col("clean_text").alias("text"))
    flagged = {r.pos for r in detect.mark_linear(cues, table).filter("is_ad").collect()}
    assert flagged == {r.pos for r in detect.detect_model(cues, fitted, 0.4).collect()} and flagged
    assert linear.linear_scores(rows.limit(0), ["id"], table).collect() == []


@pytest.mark.parametrize("n, limit", [(500, 120), (500, 500), (500, 499), (500, 1), (500, 0), (3, 10)])
def test_least_by_hash(spark, n, limit):
    """The rows a sort would give, with a row that stands there 150 times."""
    rows = texts(n) + [(9_999, "the same row", 1)] * 150
    df = spark.createDataFrame(rows, "id BIGINT, clean_text STRING, label INT").select("clean_text", "label").repartition(5)
    found = least_by_hash(df, limit, "clean_text", "label")
    sort = df.orderBy(F.xxhash64("clean_text", "label"), "clean_text").limit(limit)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, sort.collect()))
    assert "TakeOrderedAndProject" not in found._jdf.queryExecution().executedPlan().toString()


def test_cut_among_repeated_rows(spark):
    df = spark.createDataFrame([("a", 1)] * 40 + [("b", 0)] * 30, "clean_text STRING, label INT")
    for limit in (1, 29, 31, 45, 69, 70):
        found = least_by_hash(df, limit, "clean_text", "label")
        sort = df.orderBy(F.xxhash64("clean_text", "label"), "clean_text").limit(limit)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, sort.collect()))


def test_training_rows_are_bounded(samples):
    fitted = model.train(samples, vocabSize=50, maxIter=5, maxRows=60)
    assert 0 < len(fitted.stages[1].vocabulary) <= 50
