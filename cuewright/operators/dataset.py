"""Building labelled samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..session import stored
from .detect import min_length

_BUCKETS = 4096


def dedup_text(df: DataFrame) -> DataFrame:
    """Distinct normalised texts; copies are merged on both sides of the shuffle."""
    return df.select("clean_text").distinct()


def build_dataset(lines: DataFrame, label: int, min_len: int = 15, aggressive: bool = False) -> DataFrame:
    """Lines ``(text)`` to samples ``(clean_text, label)``: normalise, drop short ones, distinct."""
    normed = lines.select(normalize(F.col("text"), aggressive).alias("clean_text"))
    return dedup_text(min_length(normed, min_len)).withColumn("label", F.lit(label))


def union_datasets(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """Both classes in one table; a text found in both stays in both."""
    return pos.unionByName(neg)


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"))


def shuffle(df: DataFrame, seed: int = 42) -> DataFrame:
    """A repeatable random order. Samples are distinct per class, so no sort key is hot."""
    return df.orderBy(F.xxhash64(*df.columns, F.lit(seed)))


def stratified_split(df: DataFrame, test_share: float = 0.2, seed: int = 42, exact: bool = False) -> DataFrame:
    """Samples with ``is_test``, the share taken within each label.

    By default a sample's hash decides: no shuffle, the share holds in expectation.
    ``exact`` takes exactly the rounded share per label (samples must be distinct):
    hashes are cut into buckets, whole buckets are taken while they fit, and only
    the bucket on the edge is ranked, so no task sees a whole class. The samples are
    written once for the counts, the whole buckets and the edge.
    """
    # leading digits of a digest that every engine has
    digest = F.md5(F.concat(F.lit(f"{seed}|"), "clean_text"))
    hashed = F.conv(F.substring(digest, 1, 10), 16, 10).cast("bigint")
    if not exact:
        return df.withColumn("is_test", hashed < int(test_share * 2**40))

    rows = df.withColumn("_hash", hashed).withColumn("_bucket", F.floor(F.col("_hash") / (2**40 // _BUCKETS)).cast("int"))
    rows = stored(rows, "split")
    per_bucket = rows.groupBy("label", "_bucket").agg(F.count("*").alias("_n"))
    by_label = Window.partitionBy("label")
    before = F.sum("_n").over(by_label.orderBy("_bucket")) - F.col("_n")
    wanted = F.round(F.sum("_n").over(by_label) * test_share).cast("bigint")
    # at most _BUCKETS rows per label
    room = per_bucket.select("label", "_bucket", (wanted - before).alias("_room"), "_n")
    rows = rows.join(F.broadcast(room), ["label", "_bucket"])
    on_edge = (F.col("_room") > 0) & (F.col("_room") < F.col("_n"))
    edge = rows.filter(on_edge).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("label", "_bucket").orderBy("_hash", "clean_text"))
    )
    whole = rows.filter(~on_edge).withColumn("is_test", F.col("_room") > 0)
    edge = edge.withColumn("is_test", F.col("_rank") <= F.col("_room"))
    return whole.select(*df.columns, "is_test").unionByName(edge.select(*df.columns, "is_test"))
