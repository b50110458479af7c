"""Dense numbers for all n-grams, and feature vectors made by joins with them.

Nothing here passes the driver but one count per partition. The vocabulary is numbered by range partitions and offsets, a text's
vector is made of its rows of ``(key, gram, tf)`` joined with the numbers, and is written as the plain struct behind MLlib's vector
type, so no text's occurrences are an array and no Python runs.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import shared_folder, stored
from .features import idf, text_grams

MAX_SIZE = (1 << 31) - 1  # entries of an MLlib vector


def numbered(rows: DataFrame, *order: Column, name: str = "idx") -> DataFrame:
    """The rows with ``name`` = 0, 1, 2, ... in this order, which must tell rows apart.

    Rows are sorted by range partitions, written once with their place in their partition, and moved by the sizes of the
    partitions before: one number per partition is all that the driver sees. An empty table stays empty.
    """
    place = F.monotonically_increasing_id()  # partition << 33 | place in it
    sorted_rows = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place), "numbered")
    part = F.shiftright("_place", 33)
    sizes = sorted(sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    offsets, at = [], 0
    for r in sizes:
        offsets.append((r.part, at))
        at += r.n
    table = rows.sparkSession.createDataFrame(offsets, "_part BIGINT, _offset BIGINT")
    dense = F.col("_offset") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return sorted_rows.join(F.broadcast(table), part == F.col("_part")).select(*rows.columns, dense.alias(name))


def text_gram_counts(texts: DataFrame, keep: list[str], lo: int, hi: int, column: str = "clean_text") -> DataFrame:
    """``(*keep, gram, tf)``; store it where it is read more than once. ``keep`` begins with the text's key; texts without a gram have no row."""
    return text_grams(texts, lo, hi, keep, column)


def dictionary(frequencies: DataFrame, size: int | None = None) -> DataFrame:
    """``(gram, n, df, idx)`` from ``(gram, n, df)``: grams numbered by falling ``n``, ties by the gram; the first ``size`` of them, or all."""
    dense = numbered(frequencies.select("gram", "n", "df"), F.desc("n"), F.asc("gram"))
    return dense if size is None else dense.filter(F.col("idx") < size)


def frequencies(counts: DataFrame) -> DataFrame:
    """``(gram, n, df)``: occurrences and texts of every gram."""
    return counts.groupBy("gram").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


def weights(counts: DataFrame, numbers: DataFrame, texts: int, key: str, sublinear: bool = False) -> DataFrame:
    """``(key, idx, weight)``, not scaled; ``texts`` is the number of texts behind ``df``."""
    tf = F.lit(1.0) + F.log("tf") if sublinear else F.col("tf").cast("double")
    return counts.join(numbers, "gram").select(key, F.col("idx").cast("int").alias("idx"), (tf * idf(F.lit(texts), F.col("df"))).alias("weight"))


def feature_table(texts: DataFrame, key: str, weighted: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """``(*keep, features)`` for every text, stored; each vector of unit length, that of a text without a known gram empty.

    A vector has one entry per distinct known gram of its text. It is written as MLlib's struct of a sparse vector and read with
    MLlib's type.
    """
    if size > MAX_SIZE:
        raise ValueError(f"{size} grams are more than a vector can have")
    entry = F.struct("idx", "weight")
    # the norm is an aggregate: as an expression over the array it would be worked out again for each of its entries
    entries = weighted.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_e"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_n"))
    scaled = texts.select(key, *[c for c in keep if c != key]).join(entries, key, "left")
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).cast("int").alias("size"),
        F.coalesce(F.col("_e.idx"), F.array().cast("array<int>")).alias("indices"),
        F.coalesce(F.transform("_e.weight", lambda w: w / F.col("_n")), F.array().cast("array<double>")).alias("values"),
    )
    plain = scaled.select(*keep, vector.alias("features"))
    path = shared_folder(texts.sparkSession, "features")
    plain.write.parquet(path)
    fields = [f for f in plain.schema.fields if f.name != "features"] + [StructField("features", VectorUDT())]
    return texts.sparkSession.read.schema(StructType(fields)).parquet(path)
