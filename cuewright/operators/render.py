"""Cues back to file texts, and reports for review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cues import cue_piece, file_header, render, separator
from ..functions.text import base_name, time_range
from ..session import stored

# Cues of one part of a rebuilt file; a file with more has several parts.
CUES_PER_PART = 50_000


def render_batch(batch: DataFrame) -> DataFrame:
    """``(path, format, content)`` of a batch; a projection over file rows, no shuffle."""
    return batch.select("path", "format", render(F.col("format"), F.col("cues")).alias("content"))


def rebuild(cues: DataFrame, files: DataFrame, cues_per_part: int = CUES_PER_PART) -> DataFrame:
    """``(path, format, part, content)`` from a flat cue table.

    A file's text is its parts in order, joined by the separator of its format (see
    ``join_parts`` and ``write_files``). Parts are cut by position, so that no task
    gathers a whole file however many cues one path has. ``files`` (path, format) names
    the files, so that one is written also when all its cues were removed.
    """
    skeleton = files.select("path", "format").distinct().select(
        "path", "format", F.lit(0).alias("part"), F.lit(-1).alias("pos"), file_header(F.col("format")).alias("piece")
    )
    cue = {name: F.col(name) for name in ("cue_index", "start", "end", "text", "raw")}
    pieces = cues.select(
        "path", "format",
        F.floor(F.col("pos") / cues_per_part).cast("int").alias("part"),
        "pos",
        cue_piece(F.col("format"), cue).alias("piece"),
    )
    parts = skeleton.unionByName(pieces).groupBy("path", "format", "part").agg(
        F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("pieces")
    )
    # array_join leaves out the null header of an SRT file
    text = F.array_join(F.col("pieces.piece"), "\n")
    joined_ass = F.array_join(F.col("pieces.piece"), "")
    return parts.select("path", "format", "part", F.when(F.col("format") == "ass", joined_ass).otherwise(text).alias("content"))


def rebuild_srt(cues: DataFrame, files: DataFrame) -> DataFrame:
    return _as(cues, files, "srt")


def rebuild_vtt(cues: DataFrame, files: DataFrame) -> DataFrame:
    return _as(cues, files, "vtt")


def rebuild_ass(cues: DataFrame, files: DataFrame) -> DataFrame:
    """Events in a fresh file with default styles; untouched events keep their tags."""
    return _as(cues, files, "ass")


def _as(cues: DataFrame, files: DataFrame, fmt: str) -> DataFrame:
    return rebuild(cues.withColumn("format", F.lit(fmt)), files.withColumn("format", F.lit(fmt)))


def join_parts(parts: DataFrame) -> DataFrame:
    """``(path, format, content)``: parts put together, for files that fit one cell of a row."""
    part = F.struct("part", "content")
    grouped = parts.groupBy("path", "format").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    contents = F.filter("parts.content", lambda c: c != "")
    joined = F.when(separator(F.col("format")) == "", F.array_join(contents, "")).otherwise(F.array_join(contents, "\n"))
    return grouped.select("path", "format", joined.alias("content"))


def ad_report(flagged: DataFrame, style: str = "export") -> DataFrame:
    """Review report as lines ``(path, file, pos, line_no, line)``.

    The report is the lines in order of (path, pos, line_no); ``pos`` -1 is the
    heading of a file and the line after its last cue comes at the highest ``pos``.
    Lines carry their place as a key, so no file's report is gathered or numbered in
    one task. ``style`` is ``export`` (heading per file) or ``console`` (one line
    per cue). For the first the flagged cues are written once, so that their detection runs once though
    headings are made of them too.
    """
    cue_range = time_range(F.col("start"), F.col("end"))
    file = base_name(F.col("path")).alias("file")
    # The wording of both reports.
    if style == "console":
        head = F.concat("file", F.lit(": block "), "cue_index", F.lit(" ["), cue_range, F.lit("]"))
        body = F.concat(F.lit("    "), "text", F.lit("\n"))
    elif style == "export":
        head = F.concat(F.lit("Index: "), "cue_index", F.lit(" | Time: "), cue_range)
        body = F.concat(F.lit("Text: "), "text", F.lit("\n"))
    else:
        raise ValueError(f"unknown report style {style!r}")
    named = flagged.withColumn("file", file)
    if style == "export":
        named = stored(named.select("path", "file", "pos", "cue_index", "start", "end", "text"), "flagged")
    entry = F.split(F.concat(head, F.lit("\n"), body), "\n")
    lines = named.select("path", "file", "pos", F.posexplode(entry).alias("line_no", "line"))
    if style == "console":
        return lines
    heading = F.concat(F.lit("--- File: "), "file", F.lit(" ---"))
    last = named.groupBy("path", "file").agg(F.max("pos").alias("last"))
    frame = last.select("path", "file", F.explode(F.array(
        F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("line_no"), heading.alias("line")),
        F.struct(F.col("last").alias("pos"), F.lit(2**31 - 1).alias("line_no"), F.lit("").alias("line")),
    )).alias("l")).select("path", "file", "l.*")
    return lines.unionByName(frame)


def display_cols(cues: DataFrame) -> DataFrame:
    """What a review table shows: file name, index, time range, text."""
    return cues.select(
        "path", "pos", base_name(F.col("path")).alias("file"), "cue_index",
        time_range(F.col("start"), F.col("end")).alias("time"), "text",
    )
