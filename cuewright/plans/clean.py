"""From subtitle files to cleaned files."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regex import matches_rules
from ..functions.text import normalize
from ..operators.actions import clean, clean_batch
from ..operators.detect import Ruleset, mark_batch
from ..operators.render import rebuild, render_batch
from ..sinks.files import with_output_path
from ..sources.corpus import explode_cues, parse


def clean_files(files: DataFrame, action: str = "remove", text: str = "", texts: list[str] | None = None,
                seed: int = 42, aggressive: bool = False, ruleset: Ruleset = "full",
                out_dir: str | None = None, suffix: str = "_clean") -> DataFrame:
    """``files`` to ``(path, format, content, out_path)`` by the rules.

    Parse, flag, act and render are projections over file rows: the whole plan is one
    stage without a shuffle, and scales with the number of files.
    """
    if action == "list":
        raise ValueError("list changes no file; see flagged_cues")
    batch = mark_batch(parse(files), aggressive, ruleset)
    cleaned = render_batch(clean_batch(batch, action, text, texts, seed))
    return with_output_path(cleaned, out_dir, suffix)


def clean_files_by_model(files: DataFrame, model: PipelineModel, threshold: float, action: str = "remove",
                         text: str = "", texts: list[str] | None = None, seed: int = 42, aggressive: bool = False,
                         out_dir: str | None = None, suffix: str = "_clean") -> DataFrame:
    """The same by a trained model, as parts ``(path, format, part, content, out_path)``.

    MLlib stages score rows, so cues are unrolled for them and gathered again.
    """
    cues = explode_cues(parse(files))
    kept = clean(cues, action, text, texts, seed, model, threshold, aggressive)
    return with_output_path(rebuild(kept, files), out_dir, suffix)


def flagged_cues(files: DataFrame, aggressive: bool = False, ruleset: Ruleset = "full") -> DataFrame:
    """Flagged cues of files, with their original text."""
    return clean(explode_cues(parse(files)), "list", aggressive=aggressive, ruleset=ruleset)


def flagged_lines(texts: DataFrame, key: str, text: str = "text", aggressive: bool = False,
                  ruleset: Ruleset = "full") -> DataFrame:
    """Per text: its lines and how many of them are flagged; texts without a flag are rows too.

    Normalising a text and then cutting it into lines gives the lines' own
    normal forms (nothing composes across a line end), so ICU is called once per
    text; lines are counted inside the row.
    """
    normed = texts.select(key, normalize(F.col(text), aggressive).alias("_norm"))
    lines = normed.select(key, F.split("_norm", "\n").alias("_lines"))
    flagged = F.filter("_lines", lambda line: matches_rules(line, ruleset))
    return lines.select(key, F.size("_lines").alias("n_lines"), F.size(flagged).alias("n_ads"))
