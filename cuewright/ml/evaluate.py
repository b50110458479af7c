"""Quality of predictions ``(label 0/1, prediction 0/1, score)`` as tables."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranges the scores are cut into for running sums.
_SLICES = 512


def _cell(label: int, prediction: int) -> Column:
    return F.count_if((F.col("label") == label) & (F.col("prediction") == prediction))


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """``(label, predicted_0, predicted_1)``, one row per label."""
    return pred.groupBy("label").agg(
        *(F.count_if(F.col("prediction") == p).alias(f"predicted_{p}") for p in (0, 1))
    )


def classification_report(pred: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted means.

    One pass counts the four cells; the report is arithmetic on that single row. A
    ratio with an empty denominator is 0.
    """
    cells = pred.agg(*(_cell(l, p).alias(f"n{l}{p}") for l in (0, 1) for p in (0, 1)))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = lambda l, p: F.col(f"n{l}{p}")
    total = n(0, 0) + n(0, 1) + n(1, 0) + n(1, 1)
    rows = {}
    for c in (0, 1):
        other = 1 - c
        precision = ratio(n(c, c), n(c, c) + n(other, c))
        recall = ratio(n(c, c), n(c, c) + n(c, other))
        f1 = ratio(2.0 * n(c, c), 2 * n(c, c) + n(other, c) + n(c, other))
        rows[c] = (precision, recall, f1, n(c, c) + n(c, other))
    accuracy = ratio(n(0, 0) + n(1, 1), total)
    macro = [(rows[0][i] + rows[1][i]) / 2 for i in range(3)]
    weighted = [ratio(rows[0][i] * rows[0][3] + rows[1][i] * rows[1][3], total) for i in range(3)]
    table = [
        ("0", *rows[0]), ("1", *rows[1]), ("accuracy", accuracy, accuracy, accuracy, total),
        ("macro avg", *macro, total), ("weighted avg", *weighted, total),
    ]
    structs = [
        F.struct(F.lit(name).alias("class"), *(
            v.cast(t).alias(k) for k, v, t in zip(("precision", "recall", "f1", "support"), values, ("double",) * 3 + ("bigint",))
        ))
        for name, *values in table
    ]
    return cells.select(F.inline(F.array(*structs)))


def score_curve(pred: DataFrame) -> DataFrame:
    """Per distinct score: positives and negatives at it (``pos``, ``neg``) and at or
    above it (``tp``, ``fp``), and the totals.

    A running sum over all scores would be one window in one task. Scores are
    grouped first (equal scores merge before the shuffle), then cut into ranges at
    sampled quantiles: sums run inside a range, and add the totals of the ranges above,
    of which there are few. The cuts only balance the work, any give the same result.
    """
    by_score = pred.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    steps = [i / _SLICES for i in range(1, _SLICES)]
    cuts = by_score.agg(F.percentile_approx("score", steps, 10 * _SLICES)).first()[0] or []
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]
    sliced = Bucketizer(splits=edges, inputCol="score", outputCol="slice").transform(by_score)
    totals = sliced.groupBy("slice").agg(F.sum("pos").alias("slice_pos"), F.sum("neg").alias("slice_neg"))
    # at most _SLICES rows
    above = Window.orderBy(F.desc("slice"))
    everything = Window.partitionBy()
    offsets = totals.select(
        "slice",
        (F.sum("slice_pos").over(above) - F.col("slice_pos")).alias("pos_above"),
        (F.sum("slice_neg").over(above) - F.col("slice_neg")).alias("neg_above"),
        F.sum("slice_pos").over(everything).alias("total_pos"),
        F.sum("slice_neg").over(everything).alias("total_neg"),
    )
    running = Window.partitionBy("slice").orderBy(F.desc("score"))
    return sliced.join(F.broadcast(offsets), "slice").select(
        "score", "pos", "neg",
        (F.sum("pos").over(running) + F.col("pos_above")).alias("tp"),
        (F.sum("neg").over(running) + F.col("neg_above")).alias("fp"),
        "total_pos", "total_neg",
    )


def roc_auc(pred: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties counted half: one row, null with a single class."""
    curve = score_curve(pred)
    below = F.col("total_neg") - F.col("fp")
    won = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    pairs = F.max(F.col("total_pos").cast("double") * F.col("total_neg"))
    return curve.agg((won / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def threshold_for_recall(pred: DataFrame, recall: float = 0.95) -> DataFrame:
    """The highest score threshold that reaches the recall, and recall and precision at
    it: ``(threshold, recall, precision)``."""
    curve = score_curve(pred)
    wanted = F.ceil(F.round(F.col("total_pos") * recall, 9))
    reached = curve.filter((F.col("tp") >= wanted) & (F.col("pos") > 0))
    best = reached.agg(F.max_by(F.struct("score", "tp", "fp", "total_pos"), "score").alias("b"))
    return best.filter("b IS NOT NULL").select(
        F.col("b.score").alias("threshold"),
        (F.col("b.tp") / F.col("b.total_pos")).alias("recall"),
        (F.col("b.tp") / (F.col("b.tp") + F.col("b.fp"))).alias("precision"),
    )
