"""The classifier as a table: scoring by a join with its grams and sums, in place of MLlib's vectors.

A model is rows ``gram, idf, coefficient`` and a row of settings, stored as Parquet. A text's score is the logistic function of the intercept and
the product of its unit TF-IDF vector with the coefficients; both sums run over the grams that text and model share, so neither a
vocabulary nor a vector is held in one place, and any engine that joins can score. The scores are those of the fitted pipeline.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import at_most
from ..session import stored
from .encoding import dictionary, feature_table, frequencies, text_gram_counts, weights
from .features import CharNGrams, SublinearTF, idf, text_grams
from .model import DEFAULT_THRESHOLD, PRESETS, AdClassifier, regress

GRAMS = "gram STRING, idf DOUBLE, coefficient DOUBLE"
SENT_GRAMS = 200_000  # grams of a model that are sent to tasks whole
SETTINGS = "lo INT, hi INT, sublinear BOOLEAN, intercept DOUBLE, threshold DOUBLE"


@dataclass(frozen=True)
class LinearModel:
    """``grams``: one row a gram (``GRAMS``). Grams that are not in it have no weight and do not count for a text's length."""

    grams: DataFrame
    lo: int
    hi: int
    intercept: float
    sublinear: bool = False
    threshold: float = DEFAULT_THRESHOLD


def to_table(model: PipelineModel, threshold: float = DEFAULT_THRESHOLD) -> LinearModel:
    """A fitted pipeline as a table."""
    one = lambda kind: next(s for s in model.stages if isinstance(s, kind))
    ngrams, regression = one(CharNGrams), one(LogisticRegressionModel)
    columns = one(CountVectorizerModel).vocabulary, one(ElementwiseProduct).getScalingVec().toArray(), regression.coefficients.toArray()
    rows = [(gram, float(idf), float(weight)) for gram, idf, weight in zip(*columns)]
    return LinearModel(
        SparkSession.active().createDataFrame(rows, GRAMS), ngrams.getOrDefault("lo"), ngrams.getOrDefault("hi"), float(regression.intercept),
        any(isinstance(s, SublinearTF) for s in model.stages), threshold)


def train_table(samples: DataFrame, preset: str = "best", threshold: float = DEFAULT_THRESHOLD, **overrides) -> LinearModel:
    """The classifier of ``model.train`` fitted to a table, for vocabularies of any size.

    Grams are counted, numbered and joined to vectors as tables, see ``encoding``; the driver holds the coefficients, as in every fit by MLlib,
    and no gram. Training rows are all of them unless ``maxRows`` is given, as there. Rows with a null text or without a gram are kept with an empty vector; no gram
    at all is an error.
    """
    estimator = AdClassifier(**{**PRESETS[preset], **overrides})
    get = estimator.getOrDefault
    label = get("labelCol")
    labelled = stored(samples.select("clean_text", F.col(label).cast("double").alias(label)), "labelled")
    chosen = at_most(labelled, get("maxRows"), "clean_text", label)
    rows = stored(chosen.withColumn("_key", F.monotonically_increasing_id()), "training")
    counts = stored(text_gram_counts(rows, ["_key"], get("lo"), get("hi")), "text-grams")
    numbers = stored(dictionary(frequencies(counts), get("vocabSize") or None), "dictionary")
    n, size = rows.count(), numbers.count()
    if not size:
        raise ValueError(f"no text has an n-gram of {get('lo')} characters")
    weighted = weights(counts, numbers, n, "_key", get("sublinear"))
    fitted = regress(feature_table(rows, "_key", weighted, size, [label]), get("C"), get("penalty"), get("maxIter"), label)
    values = fitted.coefficients.toArray()
    # as Arrow columns, not as rows of Python
    coefficients = samples.sparkSession.createDataFrame(pd.DataFrame({"idx": range(size), "coefficient": values}), "idx BIGINT, coefficient DOUBLE")
    grams = numbers.join(coefficients, "idx").select("gram", idf(F.lit(n), F.col("df")).alias("idf"), "coefficient")
    return LinearModel(stored(grams, "model-grams"), get("lo"), get("hi"), float(fitted.intercept), get("sublinear"), threshold)


def save_table(model: LinearModel, path: str) -> None:
    """Grams and settings below ``path``; what is there is replaced."""
    spark = model.grams.sparkSession
    settings = (model.lo, model.hi, model.sublinear, model.intercept, model.threshold)
    model.grams.select("gram", "idf", "coefficient").write.mode("overwrite").parquet(f"{path}/grams")
    spark.createDataFrame([settings], SETTINGS).write.mode("overwrite").parquet(f"{path}/settings")


def load_table(spark: SparkSession, path: str) -> LinearModel:
    settings = spark.read.schema(SETTINGS).parquet(f"{path}/settings").first()
    return LinearModel(grams=spark.read.schema(GRAMS).parquet(f"{path}/grams"), **settings.asDict())


def linear_scores(texts: DataFrame, key: list[str], model: LinearModel, column: str = "clean_text") -> DataFrame:
    """The rows with ``score`` = P(label 1). ``key`` names columns that tell rows apart and are not null.

    A text without a gram of the model (null, short or strange) has the intercept's score. A text's grams are counted in its
    row. A model of at most ``SENT_GRAMS`` is sent to the tasks, and sums are combined there, so that one row a text is shuffled; of a larger one the planner decides.
    """
    counts = text_grams(texts, model.lo, model.hi, key, column)
    tf = F.lit(1.0) + F.log("tf") if model.sublinear else F.col("tf").cast("double")
    weight = tf * F.col("idf")
    grams = F.broadcast(model.grams) if model.grams.limit(SENT_GRAMS + 1).count() <= SENT_GRAMS else model.grams
    sums = counts.join(grams, "gram").groupBy(*key).agg(
        F.sum(weight * F.col("coefficient")).alias("_linear_dot"), F.sqrt(F.sum(weight * weight)).alias("_linear_norm"))
    logit = model.intercept + F.when(F.col("_linear_norm") > 0, F.col("_linear_dot") / F.col("_linear_norm")).otherwise(0.0)
    return texts.join(sums, key, "left").withColumn("score", 1 / (1 + F.exp(-logit))).drop("_linear_dot", "_linear_norm")
