"""From two text collections to a trained, evaluated and stored classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..ml.evaluate import classification_report, confusion_matrix, roc_auc, threshold_for_recall
from ..ml.model import at_threshold, save_model, score, train
from ..operators.dataset import build_dataset, class_counts, stratified_split, union_datasets
from ..session import shared_folder, stored


@dataclass
class Trained:
    model: PipelineModel
    threshold: float
    counts: DataFrame
    scored: DataFrame
    report: DataFrame
    confusion: DataFrame
    auc: DataFrame
    tuned: DataFrame
    tuned_report: DataFrame


def samples_from_lines(positive: DataFrame, negative: DataFrame, min_len: int = 15) -> DataFrame:
    """Both collections of lines ``(text)`` as one table of samples."""
    return union_datasets(build_dataset(positive, 1, min_len), build_dataset(negative, 0, min_len))


def train_and_evaluate(samples: DataFrame, preset: str = "best", test_share: float = 0.2, seed: int = 42,
                       recall: float = 0.95, path: str | None = None, **settings) -> Trained:
    """Split, train, score the test part, tune the threshold, and optionally store.

    The split samples are written once to the shared folder, so that neither training
    nor the reports go back through the text preparation, also after lost executors.
    """
    spark = SparkSession.active()
    folder = shared_folder(spark, "samples")
    stratified_split(samples, test_share, seed).write.parquet(folder)
    split = spark.read.parquet(folder)
    model = train(split.filter("NOT is_test"), preset, **settings)
    scored = stored(score(split.filter("is_test"), model), "scored")
    tuned = threshold_for_recall(scored, recall)
    best = tuned.first()
    threshold = best.threshold if best else 0.5
    if path is not None:
        save_model(model, path, threshold)
    return Trained(
        model, threshold, class_counts(split), scored, classification_report(scored), confusion_matrix(scored),
        roc_auc(scored), tuned, classification_report(at_threshold(scored, threshold)),
    )
