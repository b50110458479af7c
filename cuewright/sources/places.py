"""Reading again by address: keys and addresses are compared and shuffled, contents are read once, where they are used.

An address is a file and a row of it, or an archive and a place in it. Addresses are put in order by ranges, so that a task opens few files
and reads each of them forward, and a file with very many rows is shared by many tasks. Files are opened through Arrow's file systems, with the
cluster's own access to them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import stored

ROWS_PER_BATCH = 256  # rows of contents that are decoded at once


def opener():
    """A function that opens a file for reads at any place; made inside a function, so that it is sent to workers by value."""
    def open_uri(uri: str):
        from pyarrow import fs

        # the connector of the JVM has another name for the same store
        filesystem, path = fs.FileSystem.from_uri("s3://" + uri[6:] if uri.startswith("s3a://") else uri)
        return filesystem.open_input_file(path)

    return open_uri


def splits(df: DataFrame, n_bytes: int) -> int:
    """How many splits of Spark's reader so many bytes are."""
    text = df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128m").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(text[-1:], 1)
    split = int(text.rstrip("kmg")) * unit
    return math.ceil(n_bytes / split)


def tasks_for(df: DataFrame, n_bytes: int) -> int:
    """How many tasks read so many bytes of contents. Addresses say nothing of it: a partition of them that looks small may stand for very much."""
    return max(df.sparkSession.sparkContext.defaultParallelism, splits(df, n_bytes))


def in_order(addresses: DataFrame, n_bytes: int, *order: str) -> DataFrame:
    """Addresses dealt out by ranges to as many tasks as the contents behind them need, sorted in each."""
    return addresses.repartitionByRange(tasks_for(addresses, n_bytes), *order).sortWithinPartitions(*order)


def first_places(table: DataFrame, *key: str) -> DataFrame:
    """``(file, row)`` of the first row of each key, by file and place in it. ``table`` is what Spark's reader of Parquet gave, unchanged.

    Only the key is read. Copies of a key are combined before the shuffle; a null key is a key as others are.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return table.select(*key, at.alias("_at")).groupBy(*key).agg(F.min("_at").alias("_at")).select("_at.*")


def _row_reader(schema: pa.Schema):
    open_uri = opener()

    def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows at sorted addresses. Of a file, a task holds the numbers of its rows and one decoded batch."""
        from itertools import groupby

        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        def by_file():
            for batch in batches:
                files, rows = batch.column("file").dictionary_encode(), batch.column("row").to_numpy()
                codes = files.indices.to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1), len(codes)]
                for low, high in zip(cuts, cuts[1:]):
                    if high > low:
                        yield files.dictionary[int(codes[low])].as_py(), rows[low:high]

        def within(rows, low, high):
            left, right = np.searchsorted(rows, (low, high))
            return rows[left:right] - low

        for uri, parts in groupby(by_file(), key=lambda part: part[0]):
            rows = np.concatenate([part for _, part in parts])
            with open_uri(uri) as handle:
                parquet = pq.ParquetFile(handle)
                group_start = 0
                for group in range(parquet.num_row_groups):
                    size = parquet.metadata.row_group(group).num_rows
                    wanted = within(rows, group_start, group_start + size)
                    group_start += size
                    if not len(wanted):
                        continue
                    start = 0
                    for decoded in parquet.iter_batches(ROWS, row_groups=[group], columns=schema.names):
                        hits = within(wanted, start, start + len(decoded))
                        start += len(decoded)
                        if len(hits):
                            columns = [decoded.column(f.name).take(pa.array(hits)).cast(f.type) for f in schema]
                            yield pa.RecordBatch.from_arrays(columns, schema=schema)
                        if start > wanted[-1]:
                            break

    ROWS = ROWS_PER_BATCH
    return read_batches


def rows_at(table: DataFrame, places: DataFrame, columns: list[str]) -> DataFrame:
    """These columns of the rows of a Parquet table at ``places``, as ``first_places`` gives them; they must be in the files themselves, not in folder names.

    The number of tasks follows the bytes of the table's files.
    """
    schema = StructType([table.schema[c] for c in columns])
    sizes = table.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("n")).groupBy("file").agg(F.max("n").alias("n"))
    n_bytes = sizes.agg(F.sum("n")).first()[0] or 0
    return in_order(places, n_bytes, "file", "row").mapInArrow(_row_reader(to_arrow_schema(schema)), schema)


def first_rows(table: DataFrame, *key: str) -> DataFrame:
    """The first row of each key of a Parquet table, whole. No shuffle carries another column than the key."""
    return rows_at(table, stored(first_places(table, *key), "places"), table.columns)
