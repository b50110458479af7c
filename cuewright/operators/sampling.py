"""Repeatable samples of a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def at_most(df: DataFrame, limit: int, *columns: str) -> DataFrame:
    """All rows, unless the caller names a ``limit``; then ``least_by_hash``."""
    return least_by_hash(df, limit, *columns) if limit else df


def least_by_hash(df: DataFrame, limit: int, *columns: str) -> DataFrame:
    """The ``limit`` rows of least hash of these columns, equal hashes by their values; all rows if there are no more.

    The hash of rank ``limit`` is found from counts, 16 bits a pass, so no task sees more than its share of the rows. Rows below it are taken by a filter. Of the rows
    at it, which are repetitions of one row but for hash collisions, the number that is missing is made from their counts.
    """
    if limit <= 0:
        return df.limit(0)
    rows = df.withColumn("_hash", F.xxhash64(*columns))
    low, high, room = -(1 << 63), (1 << 63) - 1, limit
    for shift in (48, 32, 16, 0):
        part = rows.filter(F.col("_hash").between(low, high)).groupBy(F.shiftright("_hash", shift).alias("part")).agg(F.count("*").alias("n"))
        at = None
        for r in sorted(part.collect()):  # 65,536 rows at most
            if r.n > room:
                at = r.part
                break
            room -= r.n
        if at is None:  # only in the first pass: all rows fit
            return df
        low, high = at << shift, (at << shift) + (1 << shift) - 1
    below = rows.filter(F.col("_hash") < low).select(*df.columns)
    if not room:
        return below
    edge = rows.filter(F.col("_hash") == low).groupBy(*df.columns).agg(F.count("*").alias("_n"))
    # different rows of one hash: one but for collisions
    before = F.sum("_n").over(Window.orderBy(*columns, *[c for c in df.columns if c not in columns]).rowsBetween(Window.unboundedPreceding, -1))
    taken = F.least(F.col("_n"), F.lit(room) - F.coalesce(before, F.lit(0)))
    edge = edge.withColumn("_taken", taken).filter("_taken > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), "_taken")))
    return below.unionByName(edge.select(*df.columns))
