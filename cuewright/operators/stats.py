"""Totals and per-file counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Positions of one output row of ``ad_positions``; a file with more gets more rows.
POSITIONS_PER_ROW = 65_536


def batch_stats(cues: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Files, cues, flagged and selected cues of a marked cue table: one row.

    Cues are first counted per path, where a hot path is combined before the
    shuffle; the distinct count of files then is a count of rows. Without
    decisions every flagged cue is selected, as at the start of a review.
    """
    marked = cues.select("path", "pos", "is_ad")
    if decisions is None:
        marked = marked.withColumn("chosen", F.lit(True))
    else:
        chosen = decisions.select("path", "pos").distinct().withColumn("chosen", F.lit(True))
        marked = marked.join(chosen, ["path", "pos"], "left")
    per_path = marked.groupBy("path").agg(
        F.count("*").alias("cues"),
        F.count_if("is_ad").alias("flagged"),
        F.count_if(F.col("is_ad") & F.col("chosen")).alias("selected"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return per_path.agg(F.count("*").alias("files"), total("cues"), total("flagged"), total("selected"))


def batch_totals(batch: DataFrame) -> DataFrame:
    """The same from a marked batch, files without cues included: one row, sums only."""
    flagged = F.size(F.filter("cues", lambda cue: cue["is_ad"]))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return batch.agg(
        F.count("*").alias("files"), total(F.size("cues")).alias("cues"), total(flagged).alias("flagged")
    )


def ads_per_file(flagged: DataFrame) -> DataFrame:
    """Number of flagged cues and their first and last position, per file."""
    return flagged.groupBy("path").agg(
        F.count("*").alias("n_ads"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )


def ad_positions(flagged: DataFrame, per_row: int = POSITIONS_PER_ROW) -> DataFrame:
    """Sorted positions of flagged cues per file, cut by position so that a row stays bounded."""
    part = F.floor(F.col("pos") / per_row).cast("int").alias("part")
    return flagged.groupBy("path", part).agg(F.sort_array(F.collect_list("pos")).alias("positions"))
