"""Writing files so that all of them appear or none, with a list of what was written.

A job writes to a hidden folder of its own below the output folder. Every attempt of a task keeps its files in a folder of its own and lists them;
the list is all that it reports. The commit takes the lists of the attempts that Spark counts, then the files of these lists are moved to their names
in tasks, and the job's folder goes, with what lost or failed attempts left. The driver sees one name per task, no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.cues import SEPARATORS
from .files import checked_parts

MANIFEST = "staged STRING, out_path STRING, n_bytes BIGINT"
LIST_ROWS = 10_000  # rows of a list that a task holds


def _locate():
    """Made inside a function, so that it is sent to workers by value."""
    def locate(uri: str):
        from urllib.parse import quote

        from pyarrow import fs

        return fs.FileSystem.from_uri(uri if uri.startswith("/") else quote(uri, safe="/:@"))

    return locate


def file_sink():
    """The data source ``cue_files``; its class is made here, so that it is sent to workers by value."""
    locate, separators, list_rows = _locate(), dict(SEPARATORS), LIST_ROWS

    class Writer(DataSourceArrowWriter):
        def __init__(self, staging: str, manifest: str):
            self.staging, self.manifest = staging, manifest

        def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
            """Sorted parts to files of this attempt; after an error they are taken away again."""
            import uuid

            import pyarrow as pa
            import pyarrow.parquet as pq

            filesystem, root = locate(self.staging)
            attempt = uuid.uuid4().hex
            filesystem.create_dir(f"{root}/{attempt}")
            schema = pa.schema([("staged", pa.string()), ("out_path", pa.string()), ("n_bytes", pa.int64())])
            listed, stream, uri, written, n = [], None, None, 0, 0
            try:
                with filesystem.open_output_stream(f"{root}/{attempt}/list") as raw, pq.ParquetWriter(raw, schema) as listing:
                    def flush():
                        listing.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*listed), schema)], schema=schema))
                        listed.clear()

                    def finish():
                        stream.close()
                        listed.append((f"{self.staging}/{attempt}/{n}", uri, written))
                        if len(listed) == list_rows:
                            flush()

                    for batch in iterator:
                        columns = [batch.column(c) for c in ("out_path", "format", "content")]
                        for i in range(batch.num_rows):
                            out_path, kind, content = (c[i].as_py() for c in columns)
                            if out_path != uri or stream is None:
                                if stream is not None:
                                    finish()
                                uri, written, n = out_path, 0, n + 1
                                stream = filesystem.open_output_stream(f"{root}/{attempt}/{n}")
                            elif content:
                                written += stream.write(separators[kind].encode()) if written else 0
                            written += stream.write((content or "").encode("utf-8"))
                    if stream is not None:
                        finish()
                    if listed:
                        flush()
            except BaseException:
                filesystem.delete_dir(f"{root}/{attempt}")
                raise
            return Written(attempt)

        def commit(self, messages: list) -> None:
            filesystem, root = locate(self.staging)
            _, manifest = locate(self.manifest)
            filesystem.create_dir(manifest)
            for message in messages:
                if message is not None:
                    filesystem.move(f"{root}/{message.attempt}/list", f"{manifest}/{message.attempt}.parquet")
            filesystem.open_output_stream(f"{manifest}/_SUCCESS").close()

        def abort(self, messages: list) -> None:
            for folder in (self.staging, self.manifest):
                filesystem, path = locate(folder)
                filesystem.delete_dir_contents(path, missing_dir_ok=True)

    class Written(WriterCommitMessage):
        def __init__(self, attempt: str):
            self.attempt = attempt

    class FileSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return "cue_files"

        def writer(self, schema, overwrite: bool) -> Writer:
            return Writer(self.options["staging"], self.options["manifest"])

    return FileSink


def _mover():
    locate = _locate()

    def move_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.itertuples(index=False):
                filesystem, staged = locate(row.staged)
                _, target = locate(row.out_path)
                filesystem.create_dir(target.rpartition("/")[0])
                # a file that is not there any more was moved by an attempt before this one
                if filesystem.get_file_info(staged).type != fs.FileType.NotFound:
                    filesystem.move(staged, target)
                elif filesystem.get_file_info(target).type == fs.FileType.NotFound:
                    raise FileNotFoundError(row.staged)
            yield batch[["out_path", "n_bytes"]]

    return move_batches


def _places(folder: str, job: str) -> tuple[str, str]:
    root = folder.rstrip("/")
    return f"{root}/_writing-{job}", f"{root}/_manifest-{job}"


def publish(spark: SparkSession, folder: str, job: str) -> DataFrame:
    """Move the files of a committed job to their names and return its list ``(out_path, n_bytes)``, which stays below ``folder`` in ``_manifest-<job>``.

    May be called again after a loss half-way: what was moved before is passed over. A job that was not committed is an error.
    """
    from pyarrow import fs

    staging, manifest = _places(folder, job)
    filesystem, path = _locate()(manifest)
    if filesystem.get_file_info(f"{path}/_SUCCESS").type == fs.FileType.NotFound:
        raise ValueError(f"job {job} was not committed")
    listed = spark.read.schema(MANIFEST).parquet(manifest)
    _, path = _locate()(staging)
    if filesystem.get_file_info(path).type != fs.FileType.NotFound:
        listed.mapInPandas(_mover(), "out_path STRING, n_bytes BIGINT").write.format("noop").mode("overwrite").save()
        filesystem.delete_dir(path)
    return listed.select("out_path", "n_bytes")


def write_committed(parts: DataFrame, folder: str, names: DataFrame | None = None, job: str | None = None) -> DataFrame:
    """``write_files`` with a commit: its rows, written below ``folder``, all or none, and the list of what was written.

    Output paths must lie in the file system of ``folder``. If the job fails, no output has changed and nothing of it stays. Files of the same names are
    replaced one by one when the job is published. No rows give no file and an empty list.
    """
    spark = parts.sparkSession
    staging, manifest = _places(folder, job or uuid.uuid4().hex)
    spark.dataSource.register(file_sink())
    filesystem, path = _locate()(staging)
    filesystem.create_dir(path)
    rows = checked_parts(parts, names).select("out_path", "format", "content")
    try:
        rows.write.format("cue_files").mode("append").option("staging", staging).option("manifest", manifest).save()
    except BaseException:
        for place in (staging, manifest):
            _, path = _locate()(place)
            if filesystem.get_file_info(path).type.name != "NotFound":
                filesystem.delete_dir(path)
        raise
    return publish(spark, folder, staging.rpartition("_writing-")[2])
