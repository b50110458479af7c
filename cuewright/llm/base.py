"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.session import shared_folder


def by_value(module_name: str) -> None:
    """Send the functions of this module to workers by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once as Parquet in the cluster's shared folder and read again.

    This cuts the lineage in a way that outlives executors: what is read later needs no task that ran before.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have (whatever the case), made from these."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame, names: list[str]) -> list[Column]:
    """Columns of a table by name, dots in a name being part of it."""
    return [df[f"`{name}`"] for name in names]


def text_key(text: Column) -> Column:
    """A 128-bit digest of a text as hex; null for null."""
    return F.md5(text)


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of the named columns of two tables."""
    condition = None
    for a, b in pairs:
        one = left[a].eqNullSafe(right[b])
        condition = one if condition is None else condition & one
    return condition


by_value(__name__)
