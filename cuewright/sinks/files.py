"""Writing cleaned files, reports and samples."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cues import SEPARATORS
from ..functions.text import base_name


def output_path(path: Column, out_dir: str | None = None, suffix: str = "_clean") -> Column:
    """Stem, suffix and extension, in the output folder or beside the input.

    As in a path library, a leading dot or a final dot does not start an extension.
    """
    name = base_name(path)
    extension = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(extension))
    new_name = F.concat(stem, F.lit(suffix), extension)
    if out_dir is not None:
        return F.concat(F.lit(out_dir.rstrip("/") + "/"), new_name)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    return F.concat(folder, new_name)


def with_output_path(files: DataFrame, out_dir: str | None = None, suffix: str = "_clean") -> DataFrame:
    return files.withColumn("out_path", output_path(F.col("path"), out_dir, suffix))


def duplicate_outputs(files: DataFrame) -> DataFrame:
    """Output paths that more than one input file would be written to."""
    return (
        files.groupBy("out_path").agg(F.count_distinct("path").alias("inputs"))
        .filter("inputs > 1")
    )


def _writer():
    """The task function; made inside a function, so that it is sent to workers by value."""
    def write_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Stream sorted parts to files; a file appears under its name only when complete.

        The temporary name is this attempt's own, so a rerun or speculative task after
        the loss of an executor replaces the file with the same text. What was written is
        reported once for each batch of rows, as a frame for each file would cost more than the file.
        """
        import uuid
        from urllib.parse import unquote, urlsplit

        from pyarrow import fs

        systems: dict = {}  # one for each scheme and host
        done: list = []
        folders = set()
        filesystem = target = temporary = stream = None
        written = 0

        def finish():
            stream.close()
            filesystem.move(temporary, target)
            done.append((uri, written))

        def report():
            frame = pd.DataFrame(done, columns=["out_path", "n_bytes"])
            done.clear()
            return frame

        uri = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.out_path != uri:
                    if stream is not None:
                        finish()
                    uri, written = row.out_path, 0
                    uri_quoted = quote(uri, safe="/:@")
                    place = urlsplit(uri_quoted)
                    root = f"{place.scheme or 'file'}://{place.netloc}"
                    if root not in systems:
                        systems[root] = fs.LocalFileSystem() if root == "file://" else fs.FileSystem.from_uri(f"{root}/")[0]
                    filesystem, target = systems[root], unquote(place.path)
                    folder, _, name = target.rpartition("/")
                    if isinstance(filesystem, fs.LocalFileSystem) and folder not in folders:
                        filesystem.create_dir(folder)
                        if len(folders) < 10_000:
                            folders.add(folder)
                    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
                    stream = filesystem.open_output_stream(temporary)
                elif row.content:
                    written += stream.write(SEPARATORS[row.format].encode()) if written else 0
                written += stream.write(row.content.encode("utf-8"))
            if done:
                yield report()
        if stream is not None:
            finish()
            yield report()

    return write_batches


def checked_parts(parts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``(out_path, format, content)`` as the writers take it: the parts of a file in order in one task. An output of several inputs is an error."""
    clash = duplicate_outputs((names if names is not None else parts).select("path", "out_path")).limit(5).collect()
    if clash:
        raise ValueError("several inputs for one output path: " + ", ".join(r.out_path for r in clash))
    default = parts.sparkSession.sparkContext.getConf().get("spark.hadoop.fs.defaultFS", "file://").rstrip("/")
    rooted = F.when(F.col("out_path").startswith("/"), F.concat(F.lit(default), "out_path")).otherwise(F.col("out_path"))
    rows = parts.select(rooted.alias("out_path"), "format", *(["part"] if "part" in parts.columns else []), "content")
    if "part" in parts.columns:
        rows = rows.repartition("out_path").sortWithinPartitions("out_path", "part").drop("part")
    return rows


def write_files(parts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Write ``(out_path, format, part, content)`` rows, one file per output path.

    Returns what was written (an action on the result does the work). The parts of a
    file are sorted to one task and streamed through it, never held together; without a
    ``part`` column a row is a file, and no row moves. Paths without a scheme are of the cluster's default
    file system. Fails before writing if two inputs share an output; ``names`` (path, out_path) is looked at
    for that, where it is cheaper to compute than the contents.
    """
    return checked_parts(parts, names).mapInPandas(_writer(), "out_path STRING, n_bytes BIGINT")


def write_report(report: DataFrame, path: str) -> None:
    """Report lines as text, sorted across the output files."""
    report.orderBy("path", "pos", "line_no").select("line").write.mode("overwrite").text(path)


def write_dataset(samples: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Labelled samples; Parquet, or CSV with a header for other tools."""
    writer = samples.select("clean_text", "label").write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
