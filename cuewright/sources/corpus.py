"""Reading subtitle files, text files, lines and labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cues import cue_array, file_format, srt_cues
from ..functions.regex import SPACE
from ..functions.text import clean_tags, strip, unix_newlines
from ..schema import CUE_COLUMNS, FILES, SAMPLES
from ..session import in_few_tasks, stored
from .folders import files_of
from .places import first_places, rows_at

BOM = "\uFEFF"


def decode_files(binary: DataFrame, strip_bom: bool = False) -> DataFrame:
    """``(path, content BINARY)`` to ``(path, format, content STRING)``.

    UTF-8 with bad bytes replaced by U+FFFD and any line end made ``\\n``. A byte
    order mark stays (it costs an SRT file its first cue) unless ``strip_bom``.
    """
    content = unix_newlines(F.make_valid_utf8(F.col("content").cast("string")))
    if strip_bom:
        content = F.ltrim(content, F.lit(BOM))
    return binary.select("path", file_format(F.col("path")).alias("format"), content.alias("content"))


def read_corpus(spark: SparkSession, path: str | list[str], glob: str | None = None,
                recursive: bool = False, strip_bom: bool = False) -> DataFrame:
    """Files under a path or a list of paths as ``files``; a missing path is an error.

    Each file is one row of whole content. A root that is given twice, or lies below another one of
    a recursive reading, is left out before anything is read, so a file is kept once.
    """
    listed_twice = False
    if not isinstance(path, str):
        roots = sorted({p.rstrip("/") or "/" for p in path})
        path = [r for r in roots if not (recursive and any(r != o and r.startswith(o.rstrip("/") + "/") for o in roots))]
        # a root in another root's folder may be one of its files, or a folder of its own
        listed_twice = not recursive and any(r.rpartition("/")[0] in roots for r in path)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    binary = in_few_tasks(reader.load(path).select("path", "content"))
    return decode_files(binary.dropDuplicates(["path"]) if listed_twice else binary, strip_bom)


def files_from_table(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A table that already holds one text per file, as ``files``."""
    return df.select(
        F.col(path).alias("path"), file_format(F.col(path)).alias("format"), unix_newlines(F.col(content)).alias("content")
    )


def parse(files: DataFrame) -> DataFrame:
    """``files`` to a batch: ``(path, format, cues ARRAY)``, one row per file, no shuffle."""
    return files.select("path", "format", cue_array(F.col("format"), F.col("content")).alias("cues"))


def unroll(df: DataFrame, keep: list[str], array: Column, pos: str, item: str) -> DataFrame:
    """Rows of an array column with their position.

    The outer form is used on purpose: for the inner one the optimizer adds a
    filter on the array's size, which computes the array (here: parses the file)
    once more.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())


def explode_cues(batch: DataFrame) -> DataFrame:
    """A batch as the flat ``cues`` table keyed by ``(path, pos)``."""
    extra = [f for f in batch.schema["cues"].dataType.elementType.names if f not in CUE_COLUMNS]
    return unroll(batch, ["path", "format"], F.col("cues"), "pos", "cue").select(
        "path", "format", "pos", *[F.col(f"cue.{name}") for name in CUE_COLUMNS[3:] + extra]
    )


def srt_cue_table(files: DataFrame) -> DataFrame:
    """All files read as SRT."""
    return explode_cues(parse(files.withColumn("format", F.lit("srt"))))


def vtt_cue_table(files: DataFrame) -> DataFrame:
    """All files read as WebVTT."""
    return explode_cues(parse(files.withColumn("format", F.lit("vtt"))))


def ass_cue_table(files: DataFrame) -> DataFrame:
    """All files read as ASS/SSA."""
    return explode_cues(parse(files.withColumn("format", F.lit("ass"))))


def load_batch(files: DataFrame) -> DataFrame:
    """Many files as one batch; the path is the identity, so a path given twice counts once.

    Copies of a path are merged before the shuffle, so a path repeated very often
    sends one row per task.
    """
    return parse(files.dropDuplicates(["path"]))


def load_batch_table(table: DataFrame) -> DataFrame:
    """``load_batch`` of files that are stored as a Parquet table (``path, format, content``), passed as Spark's reader gave it.

    Paths are compared by themselves, then the content of each path's first row is read by its address; no shuffle carries a
    content, and the contents of other rows are not parsed. Of rows of one path, the first by file of the table and place in it counts; a null path
    is one path; a null content has null cues.
    """
    return parse(rows_at(table, stored(first_places(table, "path"), "places"), FILES.names))


def batch_counts(batch: DataFrame) -> DataFrame:
    """Files and cues of a batch: one row."""
    return batch.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("cues")), F.lit(0)).alias("cues"))


def dropped_chunks(files: DataFrame) -> DataFrame:
    """Per SRT file: blocks that hold text but made no cue (a lost tail, a bad index)."""
    content = F.col("content")
    blocks = F.filter(F.split(content, rf"\n[{SPACE}]*\n"), lambda chunk: strip(chunk) != "")
    return files.select("path", (F.size(blocks) - F.size(srt_cues(content))).alias("dropped"))


# ---- text for training sets -----------------------------------------------------------


def document_lines(df: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Every line of a text column as ``(key, pos, text)``; lines are not altered."""
    return unroll(df, [key], F.split(text, "\n"), "pos", "text")


def merge_texts(texts: DataFrame) -> DataFrame:
    """``(path, value)`` whole texts, tag-cleaned to one line each; texts that are not
    valid UTF-8 are left out."""
    valid = texts.filter(F.is_valid_utf8("value"))
    return valid.select("path", clean_tags(F.col("value")).alias("text"))


def read_text_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """The ``*.txt`` files of one folder as ``(path, text)``, one row per file. The driver holds no name, but where Arrow does not find the folder; there Spark's reader lists it."""
    files = files_of(spark, directory, "*.txt")
    if files is not None:
        return merge_texts(files.select("path", F.col("content").cast("string").alias("value")))
    raw = spark.read.text(directory, wholetext=True, pathGlobFilter="*.txt")
    raw = in_few_tasks(raw.select("value", F.col("_metadata.file_path").alias("file")))
    # as other readers give it: decoded
    return merge_texts(raw.select(F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B"))).alias("path"), "value"))


def clean_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines stripped, blank ones dropped, bad bytes replaced: ``(text)``."""
    text = strip(F.make_valid_utf8(F.col(column)))
    return lines.select(text.alias("text")).filter(F.col("text") != "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, ready for the dataset builder; large files are split."""
    return clean_lines(spark.read.text(path))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Labelled samples written as CSV with a header."""
    return spark.read.schema(SAMPLES).csv(path, header=True, escape='"', multiLine=True)
