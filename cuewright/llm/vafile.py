"""Exact top-k inner products by vector-approximation files.

Vectors are kept in blocks. A block has a grid of cells of its own in every dimension, and of each vector first only the cells
are read: they bound its inner product with a query from below and above. Over all blocks the k-th best lower bound of a query
is a score it reaches for certain, so only vectors whose upper bound is not below it go on. Of these the exact
vectors are read in the order of their bounds until the k-th score found is above the next bound.
Vectors that are equal are one entry with the least ids that share it, so a vector that is very common costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.base import by_value, stored

SALTS = 16
LIMIT = float(1 << 31)


def _least_ids(rows: DataFrame, k: int) -> DataFrame:
    """Of each ``key`` the ``k`` least ids; a common key is first cut down in salted parts."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for by in (["key", "salt"], ["key"]):
        salted = salted.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("n") <= k).drop("n")
    return salted.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _pack(cells: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """A block's vectors as a grid and cell numbers."""
        values = np.stack(frame["ints"].to_numpy()).astype(np.int64) if len(frame["ints"].iloc[0]) else np.zeros((len(frame), 0), np.int64)
        low = values.min(axis=0)
        step = np.maximum(-(-(values.max(axis=0) - low + 1) // cells), 1)
        code = ((values - low) // step).astype(np.uint8)
        return pd.DataFrame({"block": [key[0]], "dim": [key[1]], "keys": [frame["key"].tolist()], "low": [low.tobytes()], "step": [step.tobytes()],
                             "code": [code.tobytes()]})
    return run


def _pack_queries(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    values = np.concatenate([np.asarray(v, np.int64) for v in frame["ints"]]) if len(frame) else np.zeros(0, np.int64)
    return pd.DataFrame({"part": [key[0]], "qdim": [key[1]], "queries": [frame["qid"].tolist()], "values": [values.tobytes()]})


def _bounds(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For every query of a pack and block the vectors that may be among its best in the block, with their bounds."""
        for batch in batches:
            for row in batch.to_pylist():
                queries = np.array(row["queries"], np.int64)
                q = np.frombuffer(row["values"], np.int64).reshape(len(queries), -1).astype(np.float64)
                low, step = np.frombuffer(row["low"], np.int64), np.frombuffer(row["step"], np.int64)
                n = len(row["keys"])
                first = (np.frombuffer(row["code"], np.uint8).reshape(n, -1) * step + low).astype(np.float64)
                half = (step - 1) / 2
                middle = q @ (first + half).T
                # half a cell in every dimension, and more than the rounding of the sums
                slack = (np.abs(q) @ half)[:, None] + np.abs(q).sum(axis=1)[:, None] * np.abs(first).max(initial=1) * 1e-12 + 1e-6
                lower, upper = middle - slack, middle + slack
                kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf)
                at, which = np.nonzero(upper >= kth[:, None])
                keys = np.array(row["keys"], dtype=object)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries[at]), pa.array(keys[which].tolist(), pa.string()), pa.array(lower[at, which]), pa.array(upper[at, which])],
                    names=["qid", "key", "lower", "upper"])
    return run


def _refine(k: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Exact scores in the order of the upper bounds, as far as needed."""
        query_id = int(frame["query_id"].iloc[0])
        frame = frame.sort_values("upper", ascending=False, kind="stable")
        q = np.asarray(frame["q"].iloc[0], np.int64)
        best: list[tuple[int, int]] = []
        for upper, ids, vector in zip(frame["upper"], frame["ids"], frame["ints"]):
            if len(best) == k and -best[-1][0] > upper:
                break
            score = int(np.asarray(vector, np.int64) @ q)
            best = sorted(best + [(-score, int(i)) for i in ids if i != query_id])[:k]
        return pd.DataFrame({"query_id": query_id, "rank": np.arange(1, len(best) + 1, dtype=np.int32), "vec_id": [i for _, i in best],
                             "score": [-s for s, _ in best]}).astype({"vec_id": np.int64, "score": np.int64})
    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block_rows: int = 4_096, query_rows: int = 256,
            cells: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every query row the ``k`` highest integer inner products of ``floor(scale * x)``.

    ``vectors``: ``vec_id`` and ``embedding``; ``is_query``: condition on ``vec_id``. Rows with a null id, a null vector, or null or non-finite
    components take no part; rows repeated in id and vector count once. A query's results leave out rows with its own id, and
    vectors of another length; rows that share an id but not the vector are queries each. Ties go to the smaller id. Components beyond 2^31 after scaling are an error. An empty table
    gives an empty result; further columns are not looked at.
    """
    inf = float("inf")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    fits = lambda x: F.when(F.abs(x) < LIMIT, x.cast("long")).otherwise(F.raise_error(F.lit("a component is too large to scale")).cast("long"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: fits(F.floor(x.cast("double") * scale))).alias("ints"))
    rows = stored(rows.withColumn("key", F.sha2(F.concat_ws(",", F.lit("v"), F.col("ints").cast("ARRAY<STRING>")), 256)), "vectors")
    pairs = rows.groupBy("key", "id").agg(F.lit(1).alias("one")).drop("one")
    entries = rows.groupBy("key").agg(F.min("ints").alias("ints")).join(_least_ids(pairs, k + 1), "key")
    entries = stored(entries, "vector-entries")
    count = entries.count()
    blocks = max(1, -(-count // block_rows))
    spread = entries.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.size("ints").alias("dim"), "key", "ints")
    files = spread.groupBy("block", "dim").applyInPandas(
        _pack(cells), "block BIGINT, dim INT, keys ARRAY<STRING>, low BINARY, step BINARY, code BINARY")
    queries = rows.withColumnRenamed("id", "vec_id").filter(is_query).select(
        F.xxhash64("vec_id", "key").alias("qid"), F.col("vec_id").alias("query_id"), F.col("ints").alias("q")).dropDuplicates(["qid"])
    queries = stored(queries, "vector-queries")
    parts = max(1, -(-queries.count() // query_rows))
    packs = queries.select(F.pmod("qid", F.lit(parts)).alias("part"), F.size("q").alias("qdim"), "qid", F.col("q").alias("ints"))
    packs = packs.groupBy("part", "qdim").applyInPandas(_pack_queries, "part BIGINT, qdim INT, queries ARRAY<BIGINT>, values BINARY")
    # every pack of queries meets every block: packs and blocks are of bounded size, and their pairs are dealt over all tasks
    files = files.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    meetings = files.join(packs, (files["part"] == packs["part"]) & (files["dim"] == packs["qdim"]))
    meetings = meetings.select("block", packs["part"], "keys", "low", "step", "code", "queries", "values").repartition("block", "part")
    bounds = stored(meetings.drop("block", "part").mapInArrow(_bounds(k + 1), "qid BIGINT, key STRING, lower DOUBLE, upper DOUBLE"), "vector-bounds")
    by_query = Window.partitionBy("qid").orderBy(F.desc("lower"), "key")
    certain = bounds.withColumn("n", F.row_number().over(by_query)).filter(F.col("n") <= k + 1)
    certain = certain.groupBy("qid").agg(F.when(F.count(F.lit(1)) > k, F.min("lower")).otherwise(F.lit(-inf)).alias("reached"))
    left = bounds.join(certain, "qid").filter("upper >= reached").select("qid", "key", "upper")
    left = left.join(entries, "key").join(queries, "qid").drop("key")
    return left.groupBy("qid").applyInPandas(_refine(k), "query_id BIGINT, rank INT, vec_id BIGINT, score BIGINT")


by_value(__name__)
