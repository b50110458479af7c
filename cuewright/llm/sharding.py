"""Balanced shards: a consistent-hash ring with virtual nodes and bounded loads.

Every row has a place on a ring of ``CELLS`` cells, every shard has several virtual nodes there. A row
belongs to the first node clockwise of it. Shards have bounded loads, here exact ones: ``rows // shards``, one
more for the first ``rows % shards``; what does not fit continues clockwise to the next node whose
shard has room. Only the counts per arc of the ring decide how many rows go on to which shard, so that plan is made
from ``shards * nodes`` numbers, whatever the table's size; rows then find their own place by their rank in the arc.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.llm.base import stored

CELL_BITS = 16
CELLS = 1 << CELL_BITS


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """``(cell, shard)`` of every virtual node in clockwise order; nodes never share a cell."""
    if shards < 1 or nodes < 1 or shards * nodes > CELLS // 4:
        raise ValueError(f"between 1 and {CELLS // 4} virtual nodes fit on the ring")
    taken: dict[int, int] = {}
    for node in range(nodes):
        for shard in range(shards):
            cell = int(hashlib.md5(f"{shard}:{node}".encode()).hexdigest()[:4], 16)
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = shard
    return sorted(taken.items())


def overflow_plan(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments ``(arc, first rank, end rank, shard, first slot)`` that hold all rows of all arcs.

    Shards first take the rows of their own arcs in clockwise order; what is over is carried clockwise,
    the longest carried first. Room and rows are equally many, so two laps place everything.
    """
    if sum(counts) != sum(room):
        raise ValueError("rooms and rows differ")
    used = [0] * len(room)
    plan, over = [], {}
    for arc, (count, shard) in enumerate(zip(counts, owners)):
        take = min(count, room[shard] - used[shard])
        if take:
            plan.append((arc, 0, take, shard, used[shard]))
            used[shard] += take
        if take < count:
            over[arc] = (take, count)
    carried: list[list[int]] = []
    for step in range(2 * len(counts)):
        arc = step % len(counts)
        shard = owners[arc]
        while carried and used[shard] < room[shard]:
            origin, start, end = carried[0]
            take = min(end - start, room[shard] - used[shard])
            plan.append((origin, start, start + take, shard, used[shard]))
            used[shard] += take
            carried[0][1] += take
            if carried[0][1] == end:
                carried.pop(0)
        if arc in over:
            carried.append([arc, *over.pop(arc)])
    return plan


def _literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few constant rows, as a projection."""
    data = F.from_json(F.lit(json.dumps(rows)), f"ARRAY<STRUCT<{schema}>>")
    return spark.range(1, numPartitions=1).select(F.inline(data))


def shard_rows(rows: DataFrame, key: list, shards: int, nodes: int = 64, bucket_rows: int = 20_000) -> DataFrame:
    """The rows with ``shard INT, slot BIGINT, home_shard INT`` (the shard that owns the row's arc).

    ``key``: columns or expressions whose hash is the place on the ring. Counts per shard differ by at most one, slots
    are gapless from 0 in each shard. Rows that are equal in the whole key are interchangeable. The
    rows are stored once in the shared folder, so pass only the columns that are needed.
    """
    spark = rows.sparkSession
    columns = rows.columns
    placed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.shiftrightunsigned(F.xxhash64(*key), 1).alias("place")
    )
    placed = stored(placed, "ring")
    points = ring(shards, nodes)
    # cells up to and including a node's cell are its arc; those after the last node belong to the first
    arcs_of_cells, arc = [], 0
    for cell in range(CELLS):
        while arc < len(points) and points[arc][0] < cell:
            arc += 1
        arcs_of_cells.append(arc % len(points))
    arcs = F.from_json(F.lit(json.dumps(arcs_of_cells)), "ARRAY<INT>")
    # CELLS rows, a constant: safe to broadcast
    cells = F.broadcast(spark.range(1, numPartitions=1).select(F.posexplode(arcs).alias("cell", "arc")))
    cell = F.shiftrightunsigned("place", 63 - CELL_BITS).cast("int")

    counted = {r.arc: r.n for r in placed.select(cell.alias("cell")).groupBy("cell").count()
               .join(cells, "cell").groupBy("arc").agg(F.sum("count").alias("n")).collect()}
    total = sum(counted.values())
    owners = [shard for _, shard in points]
    room = [total // shards + (s < total % shards) for s in range(shards)]
    plan = overflow_plan([counted.get(a, 0) for a in range(len(points))], owners, room)
    segments = _literal_table(
        spark, [dict(zip(("arc", "first", "end", "shard", "slot0", "home_shard"), (*p, owners[p[0]]))) for p in plan],
        "arc INT, first BIGINT, end BIGINT, shard INT, slot0 BIGINT, home_shard INT")

    # rank in the arc: rows before the bucket, then the rank in the bucket; buckets divide cells
    bits = max(CELL_BITS, (max(1, total // bucket_rows) - 1).bit_length())
    bucket = F.shiftrightunsigned("place", 63 - bits)
    sizes = placed.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("cell", F.shiftrightunsigned("bucket", bits - CELL_BITS).cast("int")).join(cells, "cell")
    # the order in an arc that reaches over the ring's end is by bucket number all the same
    before = Window.partitionBy("arc").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", "arc", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    in_bucket = Window.partitionBy("bucket").orderBy("place", F.xxhash64("row.*"))
    ranked = placed.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(in_bucket) - 1)
    ranked = ranked.join(sizes, "bucket").withColumn("rank", F.col("rank") + F.col("before"))
    # at most two segments a virtual node and shard, a constant: safe to broadcast
    out = ranked.join(F.broadcast(segments), "arc").filter("rank >= first AND rank < end")
    return out.select("row.*", "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"), "home_shard")


def shard_documents(docs: DataFrame, shards: int = 40, nodes: int = 64) -> DataFrame:
    """Every document into one of ``shards`` shards of equally many rows (at most one apart).

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard``. ``size``: UTF-8 bytes of the text and
    16; a null text has no bytes and the CRC of the empty text. A null ``doc_id`` is a key like any other: the place on the ring
    is by id, size and CRC, so rows of one repeated id are spread. Repeated rows each take a slot of their own. An empty table
    gives an empty result; further columns of the table are not looked at. ``law`` is ``rows``; so ``grown_shard`` is null.
    """
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    out = shard_rows(rows, ["doc_id", "size", "text_crc32"], shards, nodes)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "home_shard")
