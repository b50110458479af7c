"""Web archives: records written by Spark's own writers, read back, and their index merged.

A task's records, sorted by URL key and time, are one archive; a record's text ends with the separator between records, so an archive
is a gzipped text file of Spark's, committed as such files are, on whatever file system the shared folder is. Reading an archive gives its
part of the index, a sorted run. The index is dealt out by ranges of URL key and time (so that a URL with very many
captures is spread), and in each range the runs are merged by a loser tree into the global order of captures.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.base import by_value, stored
from cuewright.session import shared_folder

SPAN = 1 << 37  # seconds, over 4,000 years
END = "\r\n\r\n"
# Names and identifiers of the WARC 1.0 format.
VERSION = "WARC/1.0"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
LEAST_BYTES = 100


def url_key(url: Column) -> Column:
    """Host parts in reverse order, then path and query: captures of a host sort together. Null gives the empty key."""
    clean = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", ""))
    host = F.regexp_extract(clean, r"^[a-z][a-z0-9+.-]*://([^/?]*)", 1)
    rest = F.regexp_replace(clean, r"^[a-z][a-z0-9+.-]*://[^/?]*", "")
    parts = F.reverse(F.split(F.regexp_replace(host, r"^www[0-9]*\.|:80$", ""), r"\."))
    return F.when(host == "", rest).otherwise(F.concat(F.array_join(parts, ","), F.lit(")"), rest))


def _uuid(digest: Column) -> Column:
    d = F.md5(digest)
    return F.concat_ws("-", *[F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def classify(pages: DataFrame, captured: Column) -> DataFrame:
    """Pages as records to be: ids, digests, and for revisits the record they refer to."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id"), F.translate("url", "\r\n", "").alias("url"), payload.alias("payload"), captured.alias("captured"),
        F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("digest"))
    rows = rows.withColumn("record", _uuid(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "url", "digest")))
    small = rows.filter(F.col("bytes") >= LEAST_BYTES).select("digest", "page_id", "record", "url", "captured")
    # least of all rows of a digest, combined before the shuffle; a null id only if there is no other
    origin = small.groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "record", "url", "captured")).alias("origin"), F.count(F.lit(1)).alias("n"))
    # stored, so that the join is one of two plain shuffles, of which Spark splits large partitions
    origin = stored(origin.filter("n > 1").select(F.col("digest").alias("d"), "origin"), "warc-origins")
    joined = rows.join(origin, (F.col("digest") == F.col("d")) & (F.col("bytes") >= LEAST_BYTES), "left")
    revisit = F.col("origin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("origin.page_id"))
    return joined.select("page_id", "url", "payload", "captured", "bytes", "digest", "record", F.when(revisit, F.col("origin")).alias("origin"))


def record_text(r: DataFrame) -> Column:
    """A record without the separator that follows it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")), F.lit("\r\n"))
    date = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("origin").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    refers = F.when(revisit, F.concat(
        line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), F.col("origin.record"), F.lit(">"))),
        line("WARC-Refers-To-Target-URI", F.col("origin.url")), line("WARC-Refers-To-Date", date(F.col("origin.captured"))))).otherwise(F.lit(""))
    return F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", date(F.col("captured"))), line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("record"), F.lit(">"))), refers,
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Page-Id", F.col("page_id").cast("string")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)


def write_archives(pages: DataFrame, folder: str, captured: Column, records: int = 10_000) -> None:
    """One record a page into archives below ``folder``, each sorted by URL key and time, with at most so many records."""
    rows = classify(pages, captured)
    run = rows.sortWithinPartitions(url_key(F.col("url")), "captured", "page_id")
    run.select(record_text(run).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records).option("compression", "gzip").text(folder)


INDEX = ("archive STRING, offset BIGINT, length BIGINT, type STRING, url STRING, date STRING, record STRING, refers STRING, page STRING, "
         "payload_bytes BIGINT, payload_digest STRING")


def _records(content: bytes) -> Iterator[tuple]:
    """Records of an archive by their lengths, whatever their content holds."""
    at, end = 0, len(content)
    while at < end:
        stop = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:stop].decode("utf-8").split("\r\n")
        if version != VERSION:
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        start, length = stop + 4, int(head["Content-Length"])
        body = content.index(b"\r\n\r\n", start) + 4
        size, digest = None, head["WARC-Payload-Digest"].removeprefix("sha256:")
        if head["WARC-Type"] == "response":
            payload = memoryview(content)[body:start + length]
            size, found = len(payload), hashlib.sha256(payload).hexdigest()
            if found != digest:
                raise ValueError(f"the payload at byte {at} is not what its digest says")
        ident = lambda x: None if x is None else x[10:-1]  # noqa: E731  without <urn:uuid: and >
        total = start + length + len(END) - at
        if content[at + total - 4:at + total] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has another length than it says")
        yield (at, total, head["WARC-Type"], head["WARC-Target-URI"], head["WARC-Date"], ident(head["WARC-Record-ID"]), ident(head.get("WARC-Refers-To")),
               head["Page-Id"] or None, size, digest)
        at += total


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string()]
    names = [x.split()[0] for x in INDEX.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            rows = [(path.as_py(), *r) for r in _records(zlib.decompress(content.as_py(), 31))]
            for a in range(0, len(rows), 10_000):
                part = list(zip(*rows[a:a + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(part, kinds)], names=names)


def read_archives(spark, folder: str) -> DataFrame:
    """A row for every record in the archives below ``folder``; the payload's size and digest are taken from the payload, where there is one."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(folder).select("path", "content")
    return found.mapInArrow(_reader, INDEX)


class LoserTree:
    """k-way merge of sorted runs: inner nodes hold the losers of the games below them, so that the next row costs one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.size = max(1, len(runs))
        self.tree = [-1] * self.size
        for i in range(len(runs)):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; a run that is over goes last."""
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, winner: int) -> None:
        node = (winner + self.size) // 2
        while node:
            other = self.tree[node]
            if other < 0:  # the first to come waits for the other side
                self.tree[node] = winner
                return
            if self._before(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs:
            winner = self.tree[0]
            head = self.heads[winner]
            if head is None:
                return
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows come run after run; out they go in one order, numbered."""
    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    archive = table.column("archive").to_pylist()
    keys = list(zip(*(table.column(c).to_pylist() for c in ("key", "date", "record", "offset")), range(len(archive))))
    cuts = [0, *[i for i in range(1, len(archive)) if archive[i] != archive[i - 1]], len(archive)]
    order = [x[-1] for x in LoserTree([iter(keys[a:b]) for a, b in zip(cuts, cuts[1:])])]
    numbered = table.take(pa.array(order, pa.int64())).append_column("place", pa.array(range(len(order)), pa.int64()))
    yield from numbered.to_batches(10_000)


def merge_index(index: DataFrame, parts: int | None = None) -> DataFrame:
    """The index with ``key`` and ``capture_no``, its place in the order of all captures by URL key, time and record, from 0."""
    keyed = index.withColumn("key", url_key(F.col("url")))
    order = ["key", "date", "record", "offset"]
    ranged = keyed.repartitionByRange(parts, *order) if parts else keyed.repartitionByRange(*order)
    runs = ranged.withColumn("part", F.spark_partition_id()).sortWithinPartitions("archive", *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema) + ", place BIGINT"
    merged = stored(runs.mapInArrow(_merger, schema), "captures")
    # as many rows as there are ranges
    counts = {r.part: r.n for r in merged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    offsets = F.array(*[F.lit(n).cast("long") for n in before or [0]])
    return merged.withColumn("capture_no", F.get(offsets, F.col("part")) + F.col("place")).drop("part", "place")


def id_seconds(page_id: Column) -> Column:
    """Seconds below ``SPAN`` for any id, so that dates have four digits in the year: a whole number modulo ``SPAN``, the CRC32 of other ids, 0 for null."""
    number = F.pmod(page_id.try_cast("bigint"), F.lit(SPAN))
    return F.coalesce(number, F.crc32(page_id.cast("binary")), F.lit(0))


def archive_pages(pages: DataFrame, captured: Column | None = None, folder: str | None = None) -> DataFrame:
    """Writes a record per page, reads the archives back, merges their index, and returns a row per page: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to, url_key, capture_no, archive, offset``.

    Of pages with equal payloads of at least 100 bytes the one with the least ``page_id`` is the response, the others revisit it; rows
    repeated with that id are responses too. A null page is an empty payload, a null url an empty one; a null ``page_id`` is a response
    if there is no other id. ``captured``: when a page was fetched; without it, ``id_seconds`` after 2020.
    An empty table gives an empty result. Further columns are not looked at.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    captured = captured if captured is not None else F.timestamp_seconds(F.lit(1_577_836_800) + id_seconds(F.col("page_id").cast("string")))
    write_archives(pages, folder, captured)
    merged = merge_index(stored(read_archives(spark, folder), "warc-index"))
    responses = merged.filter("type = 'response'").groupBy(F.col("record").alias("origin")).agg(
        F.min("page").alias("origin_page"), F.min("payload_bytes").alias("origin_bytes"))
    responses = stored(responses, "warc-responses")
    out = merged.join(responses, merged["refers"] == responses["origin"], "left")
    kind = pages.schema["page_id"].dataType
    return out.select(
        F.col("page").cast(kind).alias("page_id"), F.coalesce("payload_bytes", "origin_bytes").alias("payload_bytes"), "payload_digest",
        F.col("type").alias("record_type"), F.col("origin_page").cast(kind).alias("refers_to"), F.col("key").alias("url_key"), "capture_no",
        F.element_at(F.split("archive", "/"), -1).alias("archive"), "offset")


by_value(__name__)
