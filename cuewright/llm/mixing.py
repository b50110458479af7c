"""Sources mixed to target weights by Pfair scheduling.

Each source's rows, in a hashed order, are cut into blocks of equal size. Block ``j`` of a source of weight ``w`` (the weights sum
to 1) is released at ``floor(j / w)`` and due at ``ceil((j + 1) / w)``, in block slots; in every slot the released block that is
due first goes next. With every block in its window, what a source has had never differs by a whole block
from what its weight asks for. Weights are taken as they are, as fractions of whole numbers, so this holds however long the stream is.
When a source has no blocks left, the others go on by their own weights (a new phase).
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator, Mapping
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.llm.base import columns, fresh, same, stored, text_key
from cuewright.session import shared_folder

PLANNED = 1 << 20


def shares(weights: list[float], period: int) -> list[int]:
    """Slots of each source in a period: at least one each, the rest by largest remainder."""
    if period < len(weights):
        raise ValueError("a period needs a slot for every source")
    total = math.fsum(weights)
    exact = [w / total * period for w in weights]
    out = [max(1, math.floor(x)) for x in exact]
    while sum(out) > period:  # sources raised to one slot take it from the largest
        out[max(range(len(out)), key=lambda i: out[i] - exact[i] if out[i] > 1 else -math.inf)] -= 1
    for i in sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))[: period - sum(out)]:
        out[i] += 1
    return out


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    ratios = [float(w).as_integer_ratio() for w in weights]
    scale = max(d for _, d in ratios)  # all are powers of two
    numbers = [n * (scale // d) for n, d in ratios]
    common = math.gcd(*numbers)
    return [n // common for n in numbers]


def edf(share: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """For every slot from 0 on the source it goes to, the number of the block in its source, and the block's release and deadline.

    Of the released blocks, the one that is due first goes next. Release and deadline of block ``j`` are
    ``floor(j * total / share)`` and ``ceil((j + 1) * total / share)``.
    """
    total = sum(share)
    waiting = [(0, i, 0) for i in range(len(share))]  # by release
    ready: list[tuple[int, int, int, int]] = []  # by deadline
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            release, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // share[i]), i, j, release))
        due, i, j, release = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        yield i, j, release, due
        slot += 1
        heapq.heappush(waiting, ((j + 1) * total // share[i], i, j + 1))


def edf_period(share: list[int]) -> list[list[int]]:
    """Slots of each source in the first ``sum(share)``."""
    slots: list[list[int]] = [[] for _ in share]
    for slot, (i, *_) in enumerate(islice(edf(share), sum(share))):
        slots[i].append(slot)
    return slots


def phases(blocks: list[int], weights: list[float], period: int) -> Iterator[dict]:
    """The schedule in stretches of at most ``period`` slots: for every source in a stretch, its blocks ``first`` to ``end``, their slots from
    ``slot0`` on, and their releases and deadlines from the start of the phase."""
    left, done, start = list(blocks), [0] * len(blocks), 0
    active = [i for i, n in enumerate(left) if n]
    while active:
        course, running = edf(whole([weights[i] for i in active])), True
        while running:
            stretch: dict[int, dict] = {}
            size = 0
            while running and size < period:
                number, _, release, due = next(course)
                i = active[number]
                p = stretch.get(i) or stretch.setdefault(i, {
                    "source": i, "first": done[i], "end": done[i], "slot0": start, "period": period, "slots": [], "releases": [], "deadlines": []})
                p["slots"].append(size)
                p["releases"].append(release)
                p["deadlines"].append(due)
                p["end"] += 1
                done[i] += 1
                left[i] -= 1
                size += 1
                running = left[i] > 0
            start += size
            yield from stretch.values()
        active = [i for i in active if left[i]]


def _planned(spark: SparkSession, names: list[str | None], plan: Iterator[dict]) -> DataFrame:
    """``source, block, slot, release, deadline`` of every block; the driver holds ``PLANNED`` of them at a time."""
    path, some = shared_folder(spark, "mix-plan"), True
    whole_numbers = ("block", "slot", "release", "deadline")
    schema = "source STRING, " + ", ".join(f"{c} BIGINT" for c in whole_numbers)
    form = pa.schema([("source", pa.string()), *((c, pa.int64()) for c in whole_numbers)])
    first = True
    while some or first:
        source, numbers, some = [], [array("q") for _ in whole_numbers], False
        for p in plan:
            source += [names[p["source"]]] * len(p["slots"])
            for out, values in zip(numbers, (range(p["first"], p["end"]), (p["slot0"] + s for s in p["slots"]), p["releases"], p["deadlines"])):
                out.extend(values)
            if some := len(source) >= PLANNED:
                break
        if source or first:
            part = pa.table([pa.array(source, pa.string()), *(pa.array(np.frombuffer(x, np.int64)) for x in numbers)], schema=form)
            spark.createDataFrame(part, schema).write.mode("append").option("compression", "zstd").parquet(path)
        first = False
    return spark.read.schema(schema).parquet(path)


def mix_sources(
    docs: DataFrame, size: Column, key: Column, weights: Mapping[str | None, float] | None = None, block: int = 65_536,
    period: int = 1_024, power: float = 0.5, bucket_rows: int = 20_000, max_sources: int = 4_096,
) -> DataFrame:
    """``doc_id, key, source, size, block, release, deadline, slot, place``: where each row stands in the mixed stream.

    ``weights`` by source; without it, or for sources it leaves out, the weight is the source's total size to the
    ``power``. ``size``: a row's size in the unit of ``block``, at least 1. A row belongs to the block in which it starts; blocks inside a
    row that is larger than a block have no row of their own. ``place``: order in the block, from 0. ``release`` and ``deadline``
    count from the start of the block's phase. ``period``: slots that are planned at a time; it does not change the result. More than ``max_sources`` sources are an error, since phases are planned from
    a table of them.
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", key.alias("key"), F.col("source").alias("source"), F.greatest(size, F.lit(1)).cast("long").alias("size"),
    ).withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id", "key", F.lit("mix")), 1))
    rows = stored(rows, "mix-rows")
    totals = sorted(
        rows.groupBy("source").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect(),
        key=lambda r: (r.source is not None, r.source),
    )
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources; name groups of them")
    weights = weights or {}
    wanted = [float(weights.get(r.source, r.total ** power)) for r in totals]
    if any(not 0 < w < math.inf for w in wanted):
        raise ValueError("weights must be positive")
    blocks = _planned(spark, [r.source for r in totals], phases([-(-r.total // block) for r in totals], wanted, period))
    # block of a row: what its source has before the row's bucket, then before the row in the bucket
    bits = max(8, (max(1, sum(r.n for r in totals) // bucket_rows) - 1).bit_length())
    bucketed = rows.withColumn("bucket", F.shiftrightunsigned("place", 63 - bits))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("total")).select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    order = [F.col("place"), F.col("doc_id"), F.col("key"), F.col("size")]
    in_bucket = Window.partitionBy("source", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.withColumn("inside", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.withColumn("block", F.floor((F.col("before") + F.col("inside")) / block)).drop("s", "b")
    blocks = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), "slot", "release", "deadline")
    out = placed.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    in_block = Window.partitionBy("source", "block").orderBy(*order)
    return out.select("doc_id", "key", "source", "size", "block", "release", "deadline", "slot",
                      (F.row_number().over(in_block) - 1).alias("place"))


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """``mix_sources`` of a documents table, by bytes of text.

    A null text counts as empty, and empty texts as one byte. A null source is a source. Rows of a repeated or null ``doc_id`` are
    placed each on their own. An empty table gives an empty result; no row is left out or repeated, whatever its source's weight.
    Returns ``doc_id, source, size, block, release, deadline, slot, place`` and ``key``, the text's digest.
    """
    return mix_sources(docs, F.coalesce(F.octet_length("text"), F.lit(0)), text_key(F.col("text")), **settings)


def with_place(docs: DataFrame, name: str, **settings) -> DataFrame:
    """The documents with a column ``name STRUCT<slot, source, place>`` that orders them as the mixed stream; rows equal in id and text have the
    same. It depends on the set of rows only, not on their order or files, so that it is the same before and after the stream is written."""
    order = mix_documents(docs, **settings).groupBy("doc_id", "key").agg(F.min(F.struct("slot", "source", "place")).alias("at"))
    key, = fresh(docs, "mix_key")
    order = order.select(F.col("doc_id").alias("mix_id"), F.col("key").alias("mix_text"), F.col("at").alias("mix_at"))
    keyed = docs.withColumn(key, text_key(F.col("text")))
    joined = keyed.join(order, same(keyed, order, [("doc_id", "mix_id"), (key, "mix_text")]))
    return joined.select(*columns(keyed, docs.columns), order["mix_at"].alias(name))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents in the order of the mixed stream, columns as they are; rows equal in id and text stand together."""
    at, = fresh(docs, "mix_at")
    placed = with_place(docs, at, **settings)
    return placed.sort(at).select(*columns(placed, docs.columns))
