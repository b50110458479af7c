"""Finding advertisement cues, by rules or by a trained model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import matches_rules
from ..functions.text import normalize
from ..ml.linear import LinearModel, linear_scores
from ..ml.model import margins

Ruleset = str | list[str]


def is_ad(text: Column, aggressive: bool = False, ruleset: Ruleset = "full") -> Column:
    """True where the normalised text holds a hit of the rules.

    Aggressive normalisation deletes digits and punctuation, so link, mail and
    handle rules cannot fire under it.
    """
    return matches_rules(normalize(text, aggressive), ruleset)


def mark_rules(cues: DataFrame, aggressive: bool = False, ruleset: Ruleset = "full") -> DataFrame:
    """The cues with ``is_ad``; normalisation is computed once, in a projection below."""
    marked = cues.withColumn("_norm", normalize(F.col("text"), aggressive))
    return marked.withColumn("is_ad", matches_rules(F.col("_norm"), ruleset)).drop("_norm")


def detect_rules(cues: DataFrame, aggressive: bool = False, ruleset: Ruleset = "full") -> DataFrame:
    """Flagged cues, with their original text."""
    return mark_rules(cues, aggressive, ruleset).filter("is_ad").drop("is_ad")


def mark_model(cues: DataFrame, model: PipelineModel, threshold: float, aggressive: bool = False) -> DataFrame:
    """The cues with ``score`` = P(ad | normalised text) and ``is_ad``."""
    scored = margins(cues.withColumn("clean_text", normalize(F.col("text"), aggressive)), model, "_margin")
    score = 1 / (1 + F.exp(-F.col("_margin")))
    return scored.select(*cues.columns, score.alias("score")).withColumn("is_ad", F.col("score") >= threshold)


def mark_linear(cues: DataFrame, model: LinearModel, threshold: float | None = None, aggressive: bool = False, key: list[str] | None = None) -> DataFrame:
    """The same by a model kept as a table, at its own threshold unless another is given; ``key`` tells cues apart."""
    normed = cues.withColumn("_plain", normalize(F.col("text"), aggressive))
    scored = linear_scores(normed, key or ["path", "pos"], model, "_plain").drop("_plain")
    return scored.withColumn("is_ad", F.col("score") >= (model.threshold if threshold is None else threshold))


def detect_model(cues: DataFrame, model: PipelineModel, threshold: float = 0.5, aggressive: bool = False) -> DataFrame:
    return mark_model(cues, model, threshold, aggressive).filter("is_ad").drop("is_ad")


def mark(cues: DataFrame, model: PipelineModel | None = None, threshold: float = 0.5,
         aggressive: bool = False, ruleset: Ruleset = "full", use_model: bool = True) -> DataFrame:
    """Model if there is one and it is wanted, otherwise rules; decided when the plan is built."""
    if model is not None and use_model:
        return mark_model(cues, model, threshold, aggressive).drop("score")
    return mark_rules(cues, aggressive, ruleset)


def detect(cues: DataFrame, model: PipelineModel | None = None, threshold: float = 0.5,
           aggressive: bool = False, ruleset: Ruleset = "full", use_model: bool = True) -> DataFrame:
    return mark(cues, model, threshold, aggressive, ruleset, use_model).filter("is_ad").drop("is_ad")


def mark_batch(batch: DataFrame, aggressive: bool = False, ruleset: Ruleset = "full") -> DataFrame:
    """A batch whose cue structs carry ``is_ad``; one projection over file rows."""
    def flag(cue: Column) -> Column:
        return cue.withField("is_ad", matches_rules(cue["norm"], ruleset)).dropFields("norm")

    normed = F.transform("cues", lambda cue: cue.withField("norm", normalize(cue["text"], aggressive)))
    return batch.withColumn("cues", F.transform(normed, flag))


def keyword_filter(df: DataFrame, term: str, column: str = "text") -> DataFrame:
    """Rows whose text contains the term, whatever its case; an empty term keeps all."""
    if not term:
        return df
    return df.filter(F.contains(F.lower(column), F.lower(F.lit(term))))


def min_length(df: DataFrame, n: int = 15, column: str = "clean_text") -> DataFrame:
    """Rows of at least ``n`` code points."""
    return df.filter(F.length(column) >= n)
