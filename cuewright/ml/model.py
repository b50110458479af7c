"""Training, scoring and storing the advertisement classifier."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ngrams import prepare
from ..operators.sampling import at_most
from ..session import stored
from ..sources.places import splits
from .features import fit_tfidf, fitted_weights, vectors

# Settings of the two presets and the threshold used when none is stored.
PRESETS = {
    "best": {"C": 5.0, "lo": 3, "hi": 4, "vocabSize": 10_000, "sublinear": False},
    "plain": {"C": 1.0, "lo": 3, "hi": 6, "vocabSize": 0, "sublinear": False},
}
DEFAULT_THRESHOLD = 0.5


class AdClassifier(Estimator, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """n-gram TF-IDF and logistic regression with balanced class weights.

    ``C`` is the inverse penalty of the summed loss. MLlib averages the loss, so its
    ``regParam`` is ``1 / (C n)`` and depends on the number of training rows; that is
    why a fold of a cross-validation has to work it out when it is fitted.
    """

    C = Param(Params._dummy(), "C", "inverse of the penalty", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "l2 or l1", TypeConverters.toString)
    lo = Param(Params._dummy(), "lo", "shortest n-gram", TypeConverters.toInt)
    hi = Param(Params._dummy(), "hi", "longest n-gram", TypeConverters.toInt)
    vocabSize = Param(Params._dummy(), "vocabSize", "most frequent grams kept; 0 for all", TypeConverters.toInt)
    sublinear = Param(Params._dummy(), "sublinear", "1 + ln(tf)", TypeConverters.toBoolean)
    maxIter = Param(Params._dummy(), "maxIter", "iterations at most", TypeConverters.toInt)
    maxRows = Param(Params._dummy(), "maxRows", "labelled rows to train on at most, taken by their hash; 0 for all", TypeConverters.toInt)

    @keyword_only
    def __init__(self, C=5.0, penalty="l2", lo=3, hi=4, vocabSize=10_000, sublinear=False, maxIter=500, maxRows=0, labelCol="label"):
        super().__init__()
        self._setDefault(C=5.0, penalty="l2", lo=3, hi=4, vocabSize=10_000, sublinear=False, maxIter=500, maxRows=0, labelCol="label")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        get = self.getOrDefault
        label = get("labelCol")
        samples = dataset.select("clean_text", F.col(label).cast("double").alias(label))
        # written once: the selection, the vocabulary, its frequencies, the class sizes and the features are all made of these rows
        labelled = stored(samples, "labelled")
        samples = at_most(labelled, get("maxRows"), "clean_text", label)
        if samples is not labelled:
            samples = stored(samples, "training")
        tfidf = fit_tfidf(samples, get("lo"), get("hi"), get("vocabSize") or None, get("sublinear"))
        regression = regress(vectors(samples, tfidf, [label]), get("C"), get("penalty"), get("maxIter"), label)
        return PipelineModel([*tfidf.stages, regression])


def regress(features: DataFrame, C: float, penalty: str = "l2", maxIter: int = 500, label: str = "label",
            partitions: int | None = None) -> LogisticRegressionModel:
    """Logistic regression with balanced class weights on stored rows of ``features`` and ``label``.

    MLlib reads them twice and keeps them in blocks of its own. Each of some hundred iterations is a job over these, in ``partitions`` tasks; unless given, in one
    for every 4,000 rows, in four at least (up to five add up without a second stage) and in no more than the cluster has cores. Whatever that gives, there are so many
    tasks that none holds more than a split of the stored features, as their blocks are kept in memory or, where that is full, on disk by tasks.
    """
    counts = {r[label]: r["n"] for r in features.groupBy(label).agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, of_class in counts.items():
        weight = F.when(F.col(label) == value, n / (len(counts) * of_class)).otherwise(weight)
    tasks = max(partitions or min(max(4, n // 4_000), features.sparkSession.sparkContext.defaultParallelism), _parts(features))
    weighted = features.withColumn("weight", weight).coalesce(tasks)
    return LogisticRegression(
        featuresCol="features", labelCol=label, weightCol="weight", family="binomial",
        standardization=False, regParam=1.0 / (C * n),
        elasticNetParam={"l2": 0.0, "l1": 1.0}[penalty], maxIter=maxIter,
    ).fit(weighted)


def _parts(features: DataFrame) -> int:
    """Splits in the files of a stored table; 0 for one that is not read from files."""
    if not features.inputFiles():
        return 0
    files = features.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("n")).groupBy("file").agg(F.max("n").alias("n"))
    return splits(features, files.agg(F.sum("n")).first()[0] or 0)


def train(samples: DataFrame, preset: str = "best", **overrides) -> PipelineModel:
    """Fit the classifier on ``(clean_text, label)``."""
    return AdClassifier(**{**PRESETS[preset], **overrides}).fit(samples)


def margins(texts: DataFrame, model: PipelineModel, column: str) -> DataFrame:
    """The rows with ``column`` = the logit of P(label 1). The stages that ``train`` makes are worked out for the texts of a batch together."""
    found = fitted_weights(model)
    if found is None or not isinstance(model.stages[-1], LogisticRegressionModel):
        out = model.transform(texts)
        return out.select(*texts.columns, vector_to_array(model.stages[-1].getRawPredictionCol())[1].alias(column))
    (text, weights), regression = found, model.stages[-1]
    coefficients, intercept = regression.coefficients.toArray(), float(regression.intercept)

    def margin(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(weights.products(batch.to_pylist(), coefficients) + intercept)

    # said to be random, so that no filter on it is moved below and has it worked out once more
    return texts.withColumn(column, F.arrow_udf(margin, "double").asNondeterministic()(prepare(F.col(text))))


def score(samples: DataFrame, model: PipelineModel) -> DataFrame:
    """The rows with ``score`` = P(label 1) and the class ``prediction`` at one half."""
    out = margins(samples, model, "_margin")
    return out.select(
        *samples.columns,
        (1 / (1 + F.exp(-F.col("_margin")))).alias("score"),
        (F.col("_margin") > 0).cast("int").alias("prediction"),
    )


def at_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    """Class predictions at another threshold."""
    return scored.withColumn("prediction", (F.col("score") >= threshold).cast("int"))


def save_model(model: PipelineModel, path: str, threshold: float | None = None) -> None:
    """Model directory and, if given, a one-row threshold table below ``path``."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    if threshold is not None:
        spark.range(1).select(F.lit(float(threshold)).alias("threshold")).write.mode("overwrite").parquet(f"{path}/threshold")


def load_model(path: str) -> tuple[PipelineModel | None, float]:
    """``(model, threshold)``; no model means rules only, no threshold means one half."""
    spark = SparkSession.active()
    if not _exists(spark, f"{path}/model"):
        return None, DEFAULT_THRESHOLD
    model = PipelineModel.load(f"{path}/model")
    if not _exists(spark, f"{path}/threshold"):
        return model, DEFAULT_THRESHOLD
    return model, spark.read.parquet(f"{path}/threshold").first().threshold


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).schema
        return True
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
