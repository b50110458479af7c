"""Cleaning files as they arrive in a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import Ruleset
from ..plans.clean import clean_files, flagged_cues
from ..sources.corpus import decode_files
from ..sources.folders import qualified, stream_of

OPEN_COST = 65_536  # bytes that opening a small file counts for
_BINARY = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def landing_files(spark: SparkSession, folder: str, glob: str | None = None, files_per_batch: int = 10_000) -> DataFrame:
    """New files of a folder as a stream of ``files``; the checkpoint remembers what was seen.

    A trigger takes all files that are new. Their names are listed into files beside the checkpoint of ``clean_stream`` or ``flag_stream`` (a stream that is started otherwise
    has them in the hidden folder ``_landed`` of the landing folder), and tasks read contents at ranges of these lists: the driver holds no names, however many there are.
    A file must appear under its name when it is complete; one without bytes is looked at again at the next trigger.

    Where Arrow does not find the folder, Spark's own source lists it, which keeps all files it has seen on the driver. Its batches, of ``files_per_batch`` files, name files one
    by one. As the reader is set for few large files, each would be listed by a task of its own, and four or so be read by one; so the stream has a session of its own, with
    the caller's settings but for these two, and its tasks follow the cores and the bytes.
    """
    spark = _session_for_small_files(spark)
    place = qualified(spark, folder)
    if place is not None:
        def logged(log: str) -> DataFrame:
            return decode_files(stream_of(spark, place, glob, log))

        files = logged(f"{folder.rstrip('/')}/_landed")
        files.logged = logged
        return files
    reader = spark.readStream.format("binaryFile").schema(_BINARY).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return decode_files(reader.load(folder).select("path", "content"))


def _session_for_small_files(spark: SparkSession) -> SparkSession:
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.files.openCostInBytes", OPEN_COST)
    return own


def clean_stream(files: DataFrame, out: str, checkpoint: str, action: str = "remove", text: str = "",
                 aggressive: bool = False, ruleset: Ruleset = "full", available_now: bool = True) -> StreamingQuery:
    """Cleaned contents appended to a Parquet table; stateless, one stage per batch."""
    cleaned = clean_files(_of_checkpoint(files, checkpoint), action, text, aggressive=aggressive, ruleset=ruleset)
    return _start(cleaned, out, checkpoint, available_now)


def flag_stream(files: DataFrame, out: str, checkpoint: str, aggressive: bool = False,
                ruleset: Ruleset = "full", available_now: bool = True) -> StreamingQuery:
    """Flagged cues appended to a Parquet table for review."""
    return _start(flagged_cues(_of_checkpoint(files, checkpoint), aggressive, ruleset), out, checkpoint, available_now)


def _of_checkpoint(files: DataFrame, checkpoint: str) -> DataFrame:
    """``landing_files`` with the lists of what was seen beside the stream's checkpoint."""
    logged = files.__dict__.get("logged")
    return logged(f"{checkpoint}/landed") if logged else files


def _start(df: DataFrame, out: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(out)
