"""Removing, replacing and editing cues.

A cue is addressed by ``(path, pos)``. That pair is unique, so joins on it spread
evenly even when one path holds a large share of all cues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cues import replaced_raw, with_text
from ..schema import KEY
from .detect import Ruleset, mark

ACTIONS = ("list", "remove", "replace", "replace_random")


def _with_text(cues: DataFrame, text: Column, hit: Column) -> DataFrame:
    changed = {"text": F.when(hit, text).otherwise(F.col("text"))}
    if "raw" in cues.columns:
        changed["raw"] = F.when(hit, replaced_raw(F.col("raw"), text)).otherwise(F.col("raw"))
    return cues.withColumns(changed)


def _hits(cues: DataFrame, targets: DataFrame) -> DataFrame:
    keys = targets.select(*KEY).distinct().withColumn("_hit", F.lit(True))
    return cues.join(keys, KEY, "left")


def remove_cues(cues: DataFrame, targets: DataFrame) -> DataFrame:
    """Cues that are not among the targets."""
    return cues.join(targets.select(*KEY), KEY, "left_anti")


def replace_cues(cues: DataFrame, targets: DataFrame, text: str) -> DataFrame:
    """Target cues get one fixed text; index and times stay."""
    hit = F.col("_hit").isNotNull()
    return _with_text(_hits(cues, targets), F.lit(text), hit).select(*cues.columns)


def random_text(texts: list[str], seed: int, *key: str) -> Column:
    """A text chosen by a hash of the cue's key: the same again when a task is rerun."""
    if not texts:
        raise ValueError("there are no texts to choose from")
    pick = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(len(texts))).cast("int")
    return F.get(F.array(*map(F.lit, texts)), pick)


def replace_random(cues: DataFrame, targets: DataFrame, texts: list[str], seed: int = 42) -> DataFrame:
    """Target cues each get one of several texts."""
    hit = F.col("_hit").isNotNull()
    return _with_text(_hits(cues, targets), random_text(texts, seed, *KEY), hit).select(*cues.columns)


def apply_edits(cues: DataFrame, edits: DataFrame) -> DataFrame:
    """Per-cue manual texts ``(path, pos, new_text)``; null keeps the old text.

    Of several edits of one cue the one with the highest ``seq`` counts if there is
    such a column, otherwise the greatest text.
    """
    edits = edits.filter(F.col("new_text").isNotNull())
    last = F.max_by("new_text", "seq") if "seq" in edits.columns else F.max("new_text")
    edits = edits.groupBy(*KEY).agg(last.alias("_new_text"))
    joined = cues.join(edits, KEY, "left")
    return _with_text(joined, F.col("_new_text"), F.col("_new_text").isNotNull()).select(*cues.columns)


def only_decided(flagged: DataFrame, decisions: DataFrame) -> DataFrame:
    """Flagged cues that were chosen in review."""
    return flagged.join(decisions.select(*KEY), KEY, "left_semi")


def skip_existing(new: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    """Rows whose name is not done yet."""
    return new.join(done.select(key), key, "left_anti")


def choose_action(list_only: bool = False, remove: bool = False,
                  replace: str | None = None, replace_random: list[str] | None = None) -> str:
    """Precedence when several actions are asked for: list, remove, one text, random texts.

    No action, or an empty text, means list.
    """
    wanted = {"list": list_only, "remove": remove, "replace": replace, "replace_random": replace_random}
    return next((name for name in ACTIONS if wanted[name]), "list")


def clean(cues: DataFrame, action: str = "list", text: str = "", texts: list[str] | None = None, seed: int = 42,
          model=None, threshold: float = 0.5, aggressive: bool = False, ruleset: Ruleset = "full") -> DataFrame:
    """Detect and act in one pass, without a join: ``list`` returns the flagged cues,
    the other actions return all cues of the cleaned files."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}, expected one of {ACTIONS}")
    marked = mark(cues, model, threshold, aggressive, ruleset)
    hit = F.col("is_ad")
    if action == "list":
        done = marked.filter(hit)
    elif action == "remove":
        done = marked.filter(~hit)
    else:
        new = F.lit(text) if action == "replace" else random_text(texts or [], seed, *KEY)
        done = _with_text(marked, new, hit)
    return done.select(*cues.columns)


def clean_batch(batch: DataFrame, action: str, text: str = "", texts: list[str] | None = None, seed: int = 42) -> DataFrame:
    """The same on a marked batch (see ``mark_batch``), inside the file rows: no shuffle at all."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}, expected one of {ACTIONS}")
    if action == "replace_random" and not texts:
        raise ValueError("there are no texts to choose from")
    cues = F.col("cues")
    if action == "list":
        cues = F.filter(cues, lambda cue: cue["is_ad"])
    elif action == "remove":
        cues = F.filter(cues, lambda cue: ~cue["is_ad"])
    else:
        def changed(cue: Column, pos: Column) -> Column:
            if action == "replace":
                new = F.lit(text)
            else:
                pick = F.pmod(F.xxhash64("path", pos, F.lit(seed)), F.lit(len(texts))).cast("int")
                new = F.get(F.array(*map(F.lit, texts)), pick)
            return F.when(cue["is_ad"], with_text(cue, new)).otherwise(cue)
        cues = F.transform(cues, changed)
    return batch.withColumn("cues", F.transform(cues, lambda cue: cue.dropFields("is_ad")))
