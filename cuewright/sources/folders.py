"""Folders of very many small files: names are listed into files and contents read at them by tasks, so that the driver holds no name.

Spark's own readers keep a status and a split of every file on the driver. Here a folder is listed in chunks by one process, and a list is a table. Folders
and files are opened through Arrow's file systems; where these do not find a folder (a pattern, a list, a store that only Spark's readers reach), the callers take Spark's reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import stored
from .places import tasks_for

CONTENTS = "path STRING, content BINARY"
GROUP = 4_096  # names of a row group of a list, and files of a task of a stream at most


def _functions():
    """``(locate, scan, contents)``; made inside a function, so that they are sent to workers by value."""
    def locate(uri: str):
        from urllib.parse import quote

        from pyarrow import fs

        # the connector of the JVM has another name for the same store
        return fs.FileSystem.from_uri(quote("s3://" + uri[6:] if uri.startswith("s3a://") else uri, safe="/:@"))

    def scan(folder: str, pattern: str | None, size: int = 10_000):
        """``(names, lengths)`` of the folder's own files, so many at once: no hidden ones and none without bytes, as Spark's reader has it."""
        import os
        import re

        from pyarrow import fs

        filesystem, path = locate(folder)

        def found():
            if isinstance(filesystem, fs.LocalFileSystem):
                with os.scandir(path) as entries:
                    for entry in entries:
                        if not entry.name.startswith((".", "_")) and entry.is_file():
                            yield entry.name, entry.stat().st_size
            else:
                for info in filesystem.get_file_info(fs.FileSelector(path)):
                    if not info.base_name.startswith((".", "_")) and info.is_file:
                        yield info.base_name, info.size

        wanted = re.compile(pattern, re.DOTALL).fullmatch if pattern else lambda name: True
        names, lengths = [], []
        for name, length in found():
            if length and wanted(name) and not name.endswith("._COPYING_"):
                names.append(name)
                lengths.append(length)
                if len(names) == size:
                    yield names, lengths
                    names, lengths = [], []
        if names:
            yield names, lengths

    def contents(folder: str, names, n_bytes: int = 1 << 22, files: int = 1_000):
        """Batches ``(path, content)`` of files of a folder, of about so many bytes or files."""
        import pyarrow as pa

        filesystem, root = locate(folder)
        paths, held, waiting = [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.binary())], names=["path", "content"])

        for name in names:
            with filesystem.open_input_file(f"{root}/{name}") as stream:
                content = stream.read()
            paths.append(f"{folder}/{name}")
            held.append(content)
            waiting += len(content)
            if waiting >= n_bytes or len(held) == files:
                yield batch()
                paths, held, waiting = [], [], 0
        if held:
            yield batch()

    return locate, scan, contents


def _slashed(path: str) -> str:
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def qualified(spark: SparkSession, folder: str) -> str | None:
    """The folder as a URI without escapes, if it is one that Arrow finds."""
    from pyarrow import fs

    if not isinstance(folder, str):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    full = _slashed(full)
    try:
        filesystem, place = _functions()[0](full)
        return full if filesystem.get_file_info(place).type == fs.FileType.Directory else None
    except (OSError, ValueError, NotImplementedError):  # a store that Arrow has no way to
        return None


def name_pattern(spark: SparkSession, glob: str | None) -> str | None:
    """The regular expression that Hadoop makes of a pattern for names."""
    return spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern() if glob else None


def _lister(folder: str, pattern: str | None):
    scan = _functions()[1]

    def list_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            for _ in range(batch.num_rows):
                for names, lengths in scan(folder, pattern):
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lengths, pa.int64())], names=["name", "n_bytes"])

    return list_batches


def _reader(folder: str):
    contents = _functions()[2]

    def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from contents(folder, (name for batch in batches for name in batch.column("name").to_pylist()))

    return read_batches


def _named(files: DataFrame) -> DataFrame:
    """Paths as Hadoop writes them."""
    return files.select(F.regexp_replace("path", "^file://", "file:").alias("path"), "content")


def files_of(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame | None:
    """``(path, content BINARY)`` of the files of one folder, without those below its own folders; None if Arrow does not find it.

    One task lists the folder, as a folder is listed in turn; names are stored and dealt out. Tasks follow the bytes, and the files up to 64 tasks a core.
    """
    place = qualified(spark, folder)
    if place is None:
        return None
    listed = stored(spark.range(0, 1, 1, 1).mapInArrow(_lister(place, name_pattern(spark, glob)), "name STRING, n_bytes BIGINT"), "listed")
    found = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes")).first()
    tasks = max(tasks_for(listed, found.n_bytes), min(found.n // 1_000, 64 * spark.sparkContext.defaultParallelism))
    return _named(listed.select("name").repartition(tasks, "name").mapInArrow(_reader(place), CONTENTS))


# ---- a folder as a stream ---------------------------------------------------------------


def stream_source():
    """The data source ``landing_folder``; its class is made here, so that it is sent to workers by value."""
    locate, scan, contents = _functions()
    group_rows, schema_of_contents = GROUP, CONTENTS

    class Range(InputPartition):
        def __init__(self, start: int, low: int, high: int):
            self.start, self.low, self.high = start, low, high

    class Reader(DataSourceStreamReader):
        """Files are numbered in the order in which they were seen. Their names are kept below ``log``, a Parquet file for each time that new ones were found,
        named by the number of its first; an offset is a number. A name is seen once, whatever happens to its file later."""

        def __init__(self, options):
            self.folder, self.log, self.pattern, self.tasks = options["folder"], options["log"], options.get("pattern") or None, int(options["tasks"])
            self.known, self.seen = 0, []  # sorted digests of the first ``known`` names, in files that are mapped

        def __getstate__(self):
            return {**self.__dict__, "known": 0, "seen": []}

        def initialOffset(self):
            return {"files": 0}

        def latestOffset(self):
            while True:
                n = self._look()
                if n is not None:
                    return {"files": n}

        def partitions(self, start, end):
            a, b = start["files"], end["files"]
            size = min(max(-(-(b - a) // self.tasks), 16), group_rows)
            out = []
            for first, n in self._lists():
                low, high = max(a, first) - first, min(b, first + n) - first
                out += [Range(first, at, min(at + size, high)) for at in range(low, high, size)]
            return out

        def read(self, partition):
            filesystem, root = locate(self.log)
            names = self._names(filesystem, f"{root}/{partition.start:020d}.parquet", partition.low, partition.high)
            yield from contents(self.folder, (name for some in names for name in some))

        def _lists(self):
            """``(number of the first name, names)`` of each list, in order."""
            import pyarrow.parquet as pq
            from pyarrow import fs

            filesystem, root = locate(self.log)
            infos = filesystem.get_file_info(fs.FileSelector(root, allow_not_found=True))
            starts = sorted(int(i.base_name[:-8]) for i in infos if i.base_name.endswith(".parquet") and not i.base_name.startswith("."))
            if not starts:
                return []
            with filesystem.open_input_file(f"{root}/{starts[-1]:020d}.parquet") as handle:
                total = starts[-1] + pq.ParquetFile(handle).metadata.num_rows
            return [(a, b - a) for a, b in zip(starts, [*starts[1:], total])]

        def _names(self, filesystem, path, low, high):
            """Names ``low`` to ``high`` of a list, by its row groups."""
            import pyarrow.parquet as pq

            with filesystem.open_input_file(path) as handle:
                listed = pq.ParquetFile(handle)
                for group in range(low // group_rows, -(-high // group_rows)):
                    at = group * group_rows
                    yield listed.read_row_group(group).column("name").to_pylist()[max(low - at, 0):high - at]

        def _digests(self, names):
            from hashlib import blake2b

            import numpy as np

            return np.array([blake2b(name.encode(), digest_size=16).digest() for name in names], "S16")

        def _learn(self, lists):
            """Digests of the names of lists that are not known yet."""
            import tempfile

            import numpy as np

            new = [(first, n) for first, n in lists if first >= self.known]
            total = sum(n for _, n in new)
            if not total:
                return
            old = sum(len(s) for s in self.seen) if len(self.seen) >= 8 else 0  # many become one
            digests, at = np.memmap(tempfile.TemporaryFile(), "S16", "w+", shape=(total + old,)), 0
            if old:
                for some in self.seen:
                    digests[at:at + len(some)] = some
                    at += len(some)
                self.seen = []
            filesystem, root = locate(self.log)
            for first, n in new:
                for names in self._names(filesystem, f"{root}/{first:020d}.parquet", 0, n):
                    digests[at:at + len(names)] = self._digests(names)
                    at += len(names)
            digests.sort()
            self.seen.append(digests)
            self.known = new[-1][0] + new[-1][1]

        def _unseen(self, names):
            import numpy as np

            fresh = np.ones(len(names), bool)
            if self.seen:
                digests = self._digests(names)
                for some in self.seen:
                    at = np.minimum(np.searchsorted(some, digests), len(some) - 1)
                    fresh &= some[at] != digests
            return [name for name, new in zip(names, fresh.tolist()) if new]

        def _look(self):
            """Lists the folder and writes what is new. How many names are known; None if another stream of the same log wrote first."""
            import os
            import uuid

            import pyarrow as pa
            import pyarrow.parquet as pq
            from pyarrow import fs

            lists = self._lists()
            total = lists[-1][0] + lists[-1][1] if lists else 0
            self._learn(lists)
            filesystem, root = locate(self.log)
            filesystem.create_dir(root)
            schema, written, held = pa.schema([("name", pa.string())]), 0, []
            own, target = f"{root}/.{uuid.uuid4().hex}", f"{root}/{total:020d}.parquet"
            with filesystem.open_output_stream(own) as raw, pq.ParquetWriter(raw, schema) as listing:
                for names, _ in scan(self.folder, self.pattern):
                    held += self._unseen(names)
                    while len(held) >= group_rows:
                        listing.write_table(pa.table([pa.array(held[:group_rows], pa.string())], schema=schema), row_group_size=group_rows)
                        held, written = held[group_rows:], written + group_rows
                if held:
                    listing.write_table(pa.table([pa.array(held, pa.string())], schema=schema), row_group_size=group_rows)
                    written += len(held)
            if not written:
                filesystem.delete_file(own)
                return total
            if isinstance(filesystem, fs.LocalFileSystem):
                try:
                    os.link(own, target)
                except FileExistsError:
                    return None
                finally:
                    os.unlink(own)
            elif filesystem.get_file_info(target).type == fs.FileType.NotFound:
                filesystem.move(own, target)
            else:
                filesystem.delete_file(own)
                return None
            return total + written

    class LandingFolder(DataSource):
        @classmethod
        def name(cls) -> str:
            return "landing_folder"

        def schema(self) -> str:
            return schema_of_contents

        def streamReader(self, schema) -> Reader:
            return Reader(self.options)

    return LandingFolder


def stream_of(spark: SparkSession, place: str, glob: str | None, log: str) -> DataFrame:
    """``(path, content BINARY)`` of the files that appear in a folder as ``qualified`` gives it, as a stream. Names that were seen are kept below ``log``, which belongs to
    the stream as its checkpoint does. A trigger takes all files that are new to the log; the driver holds none of their names, but of those before digests in a mapped file."""
    spark.dataSource.register(stream_source())
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    full = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    reader = spark.readStream.format("landing_folder").option("folder", place).option("pattern", name_pattern(spark, glob) or "")
    reader = reader.option("log", _slashed(full)).option("tasks", 4 * spark.sparkContext.defaultParallelism)
    return _named(reader.load())
