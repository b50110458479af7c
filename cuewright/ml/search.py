"""Choosing the classifier's settings by cross-validated AUC."""

from __future__ import annotations

from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import at_most
from ..session import stored
from .encoding import dictionary, feature_table, text_gram_counts, weights
from .features import fit_tfidf, vectors
from .model import AdClassifier, regress

# The kinds of settings that can be searched.
SEARCHED = ("C", "penalty", "vocabSize", "ngrams", "sublinear")


def with_fold(df: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """Fold by the sample's hash, so each label is spread evenly and a rerun agrees."""
    return df.withColumn("fold", F.pmod(F.xxhash64("clean_text", F.lit(seed)), F.lit(folds)).cast("int"))


def param_maps(estimator: AdClassifier, grid: dict[str, list]) -> list[dict]:
    """All combinations; ``ngrams`` takes (lo, hi) pairs."""
    unknown = set(grid) - set(SEARCHED)
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}, expected some of {SEARCHED}")
    maps = []
    for values in product(*grid.values()):
        setting = {}
        for name, value in zip(grid, values):
            if name == "ngrams":
                setting[estimator.lo], setting[estimator.hi] = value
            else:
                setting[estimator.getParam(name)] = value
        maps.append(setting)
    return maps


def grid_search(samples: DataFrame, grid: dict[str, list], folds: int = 3, parallelism: int = 4,
                seed: int = 42, **settings) -> tuple[CrossValidatorModel, DataFrame]:
    """The fitted search (best model on all samples included) and its table of mean AUCs.

    ``settings`` are classifier settings that are not searched. The results are those of MLlib's ``CrossValidator``. TF-IDF is fitted once for a fold and kind of grams, its
    features are stored and shared by all ``C`` and penalties, and ``parallelism`` fits run beside one another: an iteration on its own leaves most of the cluster idle.
    """
    estimator = AdClassifier(**settings)
    maps = param_maps(estimator, grid)
    value = lambda setting, name: setting.get(estimator.getParam(name), estimator.getOrDefault(name))
    label, limit = estimator.getOrDefault("labelCol"), estimator.getOrDefault("maxRows")
    labelled = samples.select("clean_text", F.col(label).cast("double").alias(label))
    rows = stored(with_fold(labelled, folds, seed), "search-rows")
    evaluator = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", numBins=0)
    kinds = [tuple(value(m, name) for name in ("lo", "hi", "vocabSize", "sublinear")) for m in maps]
    tasks = -(-rows.sparkSession.sparkContext.defaultParallelism // parallelism)

    def auc(setting: dict, train: DataFrame, test: DataFrame) -> float:
        fitted = regress(train, value(setting, "C"), value(setting, "penalty"), value(setting, "maxIter"), label, tasks)
        return evaluator.evaluate(fitted.transform(test))

    aucs = [[] for _ in maps]
    with ThreadPool(parallelism) as pool:
        waiting = []
        for k in range(folds):
            outside, test = rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)
            if outside.isEmpty() or test.isEmpty():
                raise ValueError(f"fold {k} has all samples or none")
            train = at_most(outside, limit, "clean_text", label)
            if train is not outside:
                train = stored(train, "training")
            for lo, hi, size, sublinear in dict.fromkeys(kinds):
                tfidf = fit_tfidf(train, lo, hi, size or None, sublinear)
                parts = vectors(train, tfidf, [label]), vectors(test, tfidf, [label])
                for i, kind in enumerate(kinds):
                    if kind == (lo, hi, size, sublinear):
                        waiting.append((i, pool.apply_async(inheritable_thread_target(rows.sparkSession)(auc), (maps[i], *parts))))
        for i, one in waiting:
            aucs[i].append(one.get())
    means = [sum(found) / folds for found in aucs]
    best = estimator.fit(labelled, maps[max(range(len(maps)), key=means.__getitem__)])
    return CrossValidatorModel(best, means, [], [float(np.std(found)) for found in aucs]), _table(maps, means)


def _table(maps: list[dict], aucs: list[float]) -> DataFrame:
    rows = [
        (", ".join(f"{param.name}={value}" for param, value in setting.items()), float(auc))
        for setting, auc in zip(maps, aucs)
    ]
    return SparkSession.active().createDataFrame(rows, "setting STRING, auc DOUBLE")


def fold_frequencies(counts: DataFrame, folds: int, fold: str = "fold") -> DataFrame:
    """``(gram, n, df, n_0, df_0, n_1, ...)`` from ``(key, fold, gram, tf)``: frequencies in all texts and in those of each fold, in one aggregate."""
    of = lambda k: F.when(F.col(fold) == k, F.col("tf"))
    parts = [c for k in range(folds) for c in (F.coalesce(F.sum(of(k)), F.lit(0)).alias(f"n_{k}"), F.count(of(k)).alias(f"df_{k}"))]
    return counts.groupBy("gram").agg(F.sum("tf").alias("n"), F.count("*").alias("df"), *parts)


def without_fold(frequencies: DataFrame, k: int) -> DataFrame:
    """``(gram, n, df)`` of the texts outside of fold ``k``: the total less the fold's."""
    rest = frequencies.select("gram", (F.col("n") - F.col(f"n_{k}")).alias("n"), (F.col("df") - F.col(f"df_{k}")).alias("df"))
    return rest.filter("df > 0")


def shared_search(samples: DataFrame, grid: dict[str, list], folds: int = 3, seed: int = 42, **settings) -> DataFrame:
    """``(setting, auc)``: the mean AUCs of ``grid_search`` without its repeated work; the settings are fitted as there.

    Texts are cut into grams once per n-gram range, and document frequencies of all folds come of one aggregate. The features of a fold are made and
    stored once for all penalties ``C`` and kinds of penalty. ``maxRows``, if given, bounds the rows of the whole search, not of each fold's training. A fold
    with one class only has AUC zero or one by MLlib's definition; rows with a null text have an empty vector.
    """
    estimator = AdClassifier(**settings)
    maps = param_maps(estimator, grid)
    value = lambda setting, name: setting.get(estimator.getParam(name), estimator.getOrDefault(name))
    label = estimator.getOrDefault("labelCol")
    labelled = stored(samples.select("clean_text", F.col(label).cast("double").alias(label)), "labelled")
    chosen = with_fold(at_most(labelled, estimator.getOrDefault("maxRows"), "clean_text", label), folds, seed)
    rows = stored(chosen.withColumn("_key", F.monotonically_increasing_id()), "search-rows")
    sizes = {r.fold: r["count"] for r in rows.groupBy("fold").count().collect()}
    total = sum(sizes.values())
    evaluator = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", numBins=0)
    aucs = [0.0] * len(maps)

    def unique(names: tuple, chosen: list[int]) -> list[tuple]:
        return sorted({tuple(value(maps[i], n) for n in names) for i in chosen})

    for lo, hi in unique(("lo", "hi"), list(range(len(maps)))):
        in_range = [i for i, m in enumerate(maps) if (value(m, "lo"), value(m, "hi")) == (lo, hi)]
        counts = stored(text_gram_counts(rows, ["_key", "fold"], lo, hi), "text-grams")
        frequencies = stored(fold_frequencies(counts, folds), "fold-frequencies")
        for k in range(folds):
            outside = total - sizes.get(k, 0)
            numbers = stored(dictionary(without_fold(frequencies, k)), "fold-dictionary")
            for vocab_size, sublinear in unique(("vocabSize", "sublinear"), in_range):
                kept = numbers.filter(F.col("idx") < vocab_size) if vocab_size else numbers
                size = kept.count()
                if not size:
                    raise ValueError(f"no text outside of fold {k} has an n-gram of {lo} characters")
                weighted = weights(counts, kept, outside, "_key", sublinear)
                features = feature_table(rows, "_key", weighted, size, ["fold", label])
                train, test = features.filter(F.col("fold") != k), features.filter(F.col("fold") == k)
                for i in in_range:
                    if (value(maps[i], "vocabSize"), value(maps[i], "sublinear")) == (vocab_size, sublinear):
                        fitted = regress(train, value(maps[i], "C"), value(maps[i], "penalty"), value(maps[i], "maxIter"), label)
                        aucs[i] += evaluator.evaluate(fitted.transform(test)) / folds
    return _table(maps, aucs)
