"""Session settings the operators are written for."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # file texts are wide rows: small batches between the JVM and Python
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    # the caller may ask for other splits; many small files share one
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.files.openCostInBytes": "1m",
    # the parsers are large expressions; without call sites they are built twice as fast
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def build_session(name: str = "cuewright", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Without that setting a local session gets a temporary folder; on a cluster it is an error, since every executor would
    write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="cuewright-")
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once to the shared folder and read again: what is read later needs no task that ran before."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, partitions: int | str | None = None) -> DataFrame:
    """Rows dealt out to as many partitions as the caller asks for; without a number nothing is done.

    The reader splits large inputs by itself. Only an input of few row groups, such as a small test file, gains from this.
    """
    return df.repartition(int(partitions)) if partitions else df


def in_few_tasks(files: DataFrame) -> DataFrame:
    """Files just read, in tasks bounded by the number of cores. The reader counts 4 MB for the opening of a file, so that very many small ones would be as
    many tasks as there are some dozen of them; their partitions are read one after another by a task, and no row moves."""
    return files.coalesce(64 * files.sparkSession.sparkContext.defaultParallelism)
