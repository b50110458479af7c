"""Members of zip archives."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import in_few_tasks, stored
from .places import in_order, opener

PLACES = "archive STRING, uri STRING, ordinal INT, name STRING, n_bytes BIGINT, error STRING"
MEMBERS = "archive STRING, ordinal INT, name STRING, content BINARY, error STRING"


def _unpacker():
    """The task function; made inside a function, so that it is sent to workers by value
    and they need not have this package installed."""
    def unpack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One output batch per member, so that a task holds one archive and one member."""
        def row(*values):
            arrays = [pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string()))]
            return pa.RecordBatch.from_arrays(arrays, names=["archive", "ordinal", "name", "content", "error"])

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                archive = path.as_py()
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as zipped:
                        for ordinal, entry in enumerate(zipped.infolist()):
                            name = posixpath.basename(entry.filename)
                            if name and not entry.is_dir():
                                yield row(archive, ordinal, name, zipped.read(entry), None)
                except Exception as error:  # a bad archive is reported, the job goes on
                    yield row(archive, None, None, None, f"{type(error).__name__}: {error}")

    return unpack_batches


def in_folder(archives: DataFrame, folder: str) -> DataFrame:
    """Zip archives whose parent folder has this name, whatever its case."""
    parent = F.lower(F.element_at(F.split("path", "/"), -2))
    return archives.filter(F.lower("path").endswith(".zip") & (F.size(F.split("path", "/")) > 1) & (parent == folder.lower()))


def unpack(archives: DataFrame) -> DataFrame:
    """``(path, content BINARY)`` to one row per member, plus one per bad archive."""
    return archives.select("path", "content").mapInArrow(_unpacker(), MEMBERS)


def first_of_name(members: DataFrame) -> DataFrame:
    """The first member of each base name, by archive path and place in the archive.

    Only names and places are compared; a name found in every archive leaves one row
    per task. Then the members at those places are taken, so pass members that are stored
    (see ``stored``) or cheap: they are read twice.
    """
    place = F.struct("archive", "ordinal")
    first = members.filter(F.col("error").isNull()).groupBy("name").agg(F.min(place).alias("place")).select("place.*", F.lit(True).alias("first"))
    return members.join(first, ["archive", "ordinal"], "left_semi").select("archive", "ordinal", "name", "content")


def bad_archives(members: DataFrame) -> DataFrame:
    return members.filter(F.col("error").isNotNull()).select("archive", "error")


def _found(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """Zip archives below ``root`` in folders of this name, as the reader lists them; the folder is tested on the files' metadata."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{zip,ZIP}")
        .load(root)
    )
    listed = F.lower(F.element_at(F.split("_metadata.file_path", "/"), -2)) == quote(folder).lower()
    return found.filter(listed)


def read_archives(spark: SparkSession, root: str, folder: str = "farsi") -> DataFrame:
    """Members of the zip archives below ``root`` that lie in folders of this name.

    The folder is tested on the file's metadata, by which Spark drops the other archives
    when it lists them, before any content is read. Returns every member and error; see
    ``first_of_name`` and ``bad_archives``.
    """
    return unpack(in_few_tasks(_found(spark, root, folder).select("path", "content")))


# ---- the first member of each name, by the archives' directories ------------------------


def _zip_opener():
    """Opens a file the way Python's zip reader expects it; a seek to before its start is an ``OSError``."""
    open_uri = opener()

    class File(io.RawIOBase):
        def __init__(self, uri):
            self.inner = open_uri(uri)

        def readable(self):
            return True

        def seekable(self):
            return True

        def readinto(self, buffer):
            return self.inner.readinto(buffer)

        def tell(self):
            return self.inner.tell()

        def seek(self, offset, whence=0):
            target = offset + (0, self.inner.tell(), self.inner.size())[whence]
            if target < 0:
                raise OSError("seek to before the start")
            return self.inner.seek(target)

        def close(self):
            self.inner.close()
            io.RawIOBase.close(self)

    return lambda uri: io.BufferedReader(File(uri))


def _lister():
    open_uri = _zip_opener()

    def list_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members as the directory at an archive's end names them; no content is read."""
        def table(rows):
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string())
            names = ["archive", "uri", "ordinal", "name", "n_bytes", "error"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for archive, uri in zip(batch.column("archive").to_pylist(), batch.column("uri").to_pylist()):
                try:
                    with open_uri(uri) as handle, zipfile.ZipFile(handle) as zipped:
                        rows = []
                        for ordinal, entry in enumerate(zipped.infolist()):
                            name = posixpath.basename(entry.filename)
                            if name and not entry.is_dir():
                                rows.append((archive, uri, ordinal, name, entry.compress_size, None))
                except Exception as error:  # a bad archive is reported, the job goes on
                    rows = [(archive, uri, None, None, None, f"{type(error).__name__}: {error}")]
                if rows:
                    yield table(rows)

    return list_batches


def _member_reader():
    open_uri = _zip_opener()

    def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members at sorted places, one output batch each; an archive is opened once for those that follow each other."""
        def row(*values):
            arrays = [pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string()))]
            return pa.RecordBatch.from_arrays(arrays, names=["archive", "ordinal", "name", "content", "error"])

        at = handle = zipped = None
        try:
            for batch in batches:
                for place in batch.to_pylist():
                    archive, ordinal, name = place["archive"], place["ordinal"], place["name"]
                    try:
                        if place["uri"] != at:
                            if handle is not None:
                                handle.close()
                            at, handle = None, open_uri(place["uri"])
                            zipped = zipfile.ZipFile(handle)
                            at = place["uri"]
                        content, error = zipped.read(zipped.infolist()[ordinal]), None
                    except Exception as failure:  # a bad member is reported, the job goes on
                        content, error = None, f"{type(failure).__name__}: {failure}"
                    yield row(archive, ordinal, name, content, error)
        finally:
            if handle is not None:
                handle.close()

    return read_batches


def list_members(spark: SparkSession, root: str, folder: str = "farsi") -> DataFrame:
    """``PLACES`` of the members of the archives that ``read_archives`` reads, and one row with ``error`` per archive whose directory cannot be read.

    An archive's directory is read by itself, by byte ranges at its end. An archive without members has no row.
    """
    found = _found(spark, root, folder).select(F.col("path").alias("archive"), F.col("_metadata.file_path").alias("uri"))
    return in_few_tasks(found).mapInArrow(_lister(), PLACES)


def read_members(places: DataFrame) -> DataFrame:
    """``MEMBERS`` at these places; ``error`` tells why a member could not be read. Pass stored places: their sizes are summed first."""
    n_bytes = places.agg(F.sum("n_bytes")).first()[0] or 0
    wanted = in_order(places.select("archive", "uri", "ordinal", "name"), n_bytes, "archive", "ordinal")
    return wanted.mapInArrow(_member_reader(), MEMBERS)


def extract_first(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(archive, ordinal, name, content)`` of the first member of each name, and ``(archive, error)`` of what could not be read.

    ``listed`` is what ``list_members`` gives. Names and places are compared, and only members that are first of their name are unpacked, each once. As where
    archives are unpacked one after the other, a member that cannot be read ends its archive: names that were
    to come of it from there on are taken from their next place. That takes another round, of these names only, until nothing new fails; members read in an earlier
    round from behind such an end are left out by a join with the ends, which are as many as there are broken archives.
    """
    listed = stored(listed, "listed")
    places = listed.filter(F.col("error").isNull()).drop("error")
    candidates, rounds, ends = places, [], None
    while True:
        place = F.struct("archive", "ordinal", "uri", "n_bytes")
        wanted = candidates.groupBy("name").agg(F.min(place).alias("at")).select("at.*", "name")
        for done in rounds:
            wanted = wanted.join(done.select("archive", "ordinal"), ["archive", "ordinal"], "left_anti")
        read = stored(read_members(stored(wanted, "wanted")), "members")
        rounds.append(read)
        failed = read.filter(F.col("error").isNotNull()).select("archive", F.col("ordinal").alias("end"))
        if failed.isEmpty():
            break
        failed = failed if ends is None else failed.union(ends)
        ends = stored(failed.groupBy("archive").agg(F.min("end").alias("end")), "ends")
        candidates = _before(places, ends)
    errors = listed.filter(F.col("error").isNotNull()).select("archive", "error")
    members = None
    for read in rounds:
        good = read.filter(F.col("error").isNull())
        good = (good if ends is None else _before(good, ends)).select("archive", "ordinal", "name", "content")
        members = good if members is None else members.unionByName(good)
        if ends is not None:
            errors = errors.union(read.filter(F.col("error").isNotNull()).join(ends, (read["archive"] == ends["archive"]) & (F.col("ordinal") == F.col("end")), "left_semi")
                                  .select("archive", "error"))
    return members, errors


def _before(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows that stand before the end of their archive."""
    ended = ends.select(F.col("archive").alias("_archive"), "end")
    return rows.join(ended, (F.col("archive") == F.col("_archive")) & (F.col("ordinal") >= F.col("end")), "left_anti")
