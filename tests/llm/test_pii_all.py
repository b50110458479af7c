"""The trees and thresholds of personal data come from all candidates."""

import random

import pytest
from pyspark.sql import functions as F

from cuewright.llm import pii


@pytest.mark.parametrize("precision", [0.5, 0.8, 0.95, 1.0])
def test_threshold_against_a_sorted_list(spark, precision):
    rng = random.Random(int(precision * 100))
    rows = [(round(s, 3), float(rng.random() < s), float(rng.randint(1, 4))) for s in (rng.random() for _ in range(400))]
    each = sorted(((s, label) for s, label, n in rows for _ in range(int(n))), reverse=True)
    right, expected = 0.0, None
    for i, (score, label) in enumerate(each):
        right += label
        if right / (i + 1) >= precision and (i + 1 == len(each) or each[i + 1][0] < score):
            expected = score if i + 1 == len(each) else (score + each[i + 1][0]) / 2
    assert pii._threshold(spark.createDataFrame(rows, "score DOUBLE, label DOUBLE, n DOUBLE"), precision) == expected


def test_no_score_is_sure_enough(spark):
    rows = [(0.9, 0.0, 3.0), (0.4, 1.0, 1.0)]
    assert pii._threshold(spark.createDataFrame(rows, "score DOUBLE, label DOUBLE, n DOUBLE"), 0.5) is None
    assert pii._threshold(spark.createDataFrame([], "score DOUBLE, label DOUBLE, n DOUBLE"), 0.5) is None


def test_every_candidate_trains(spark, monkeypatch):
    """20,000 candidates that differ in form; the weights that reach the trees are all of them but the tenth held back."""
    wide = F.array(F.struct(
        F.lit(0).alias("start"), F.lit(9).alias("end"),
        F.transform(F.sequence(F.lit(1), F.lit(len(pii.FEATURES))), lambda i: F.pmod(F.xxhash64("id", i), F.lit(50)).cast("double")).alias("x"),
        (F.col("id") % 2 == 0).alias("base")))
    none = F.filter(wide, lambda c: F.lit(False))
    given = spark.range(20_000).select(F.xxhash64("id").alias("__id"), *[(wide if k == "phone" else none).alias(f"{k}_wide") for k in pii.KINDS])
    seen = {}

    class Trees:
        treeWeights, trees = [], []

        def __init__(self, **settings):
            seen.update(settings)

        def fit(self, rows):
            seen["rows"] = rows.agg(F.sum("n")).first()[0]
            return self

    monkeypatch.setattr(pii, "GBTClassifier", Trees)
    pii.fit(given)
    held = given.filter("pmod(xxhash64(xxhash64(__id, 0)), 10) = 0").count()
    assert seen["weightCol"] == "n" and seen["rows"] == 20_000 - held and 1_500 < held < 2_500
