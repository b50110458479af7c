"""Near duplicates by MinHash: minima of many universal hashes, bands, signatures, exact sets, and stars for the components.

A document is the set of its word shingles. ``bands * rows`` hashes of a universal family give each set as many minima. Two sets of
similarity ``s`` agree in a minimum with probability ``s``, in all of a band with ``s ** rows``, and in some band with
``1 - (1 - s ** rows) ** bands``: with 48 bands of 6 that is 0.9999995 at 0.8 and more above. Equal sets are one node from the start, so a
group of copies costs one row.

Nodes that agree in a band are a bucket. Signatures, one byte a minimum, tell which pairs of a bucket may be linked; a bucket gives a forest over
these, and alternating large and small stars make families of them: whatever is linked is in one family. Then the full sets of a family meet in a task, where they are compared,
and again a forest of the true links leaves it, of which stars make the components. Large buckets and families are cut into blocks, and a pair of blocks is one
group of a task: no group grows with its bucket or family, no pair is left out, and only tree edges are rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.base import by_value, stored, text_key
from cuewright.llm.simhash import components

BANDS, ROWS = 48, 6
SIGNATURE = 128  # minima of which a byte is kept
BLOCK = 2_048  # nodes of a bucket or family that are one block
MEMBERS = 1 << 21  # shingles of a family's block


class Family:
    """Multiply-add hashes ``a * x + b`` modulo 2**64, ``a`` odd, drawn once with a fixed seed."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 11):
        draw = np.random.default_rng(seed).integers(0, 1 << 64, (3, bands * rows), np.uint64)
        self.bands, self.rows = bands, rows
        self.a, self.b = (draw[0] | np.uint64(1))[:, None], draw[1][:, None]
        self.mix = (draw[2] | np.uint64(1)).reshape(bands, rows)
        self.room = np.empty((bands * rows, 512), np.uint64)

    def minima(self, members: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), ~np.uint64(0))
        for at in range(0, len(members), 512):
            part = members[None, at:at + 512]
            room = self.room[:, :part.shape[1]]
            np.multiply(self.a, part, out=room)
            np.add(room, self.b, out=room)
            np.minimum(least, room.min(axis=1), out=least)
        return least

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key a band, of all its minima and its number."""
        key = (scramble(minima).reshape(self.bands, self.rows) * self.mix).sum(axis=1, dtype=np.uint64)
        return scramble(key + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A mixing of all 64 bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(raw: bytes, shingle: int, words: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; of all its words if they are fewer, of none if there are none.

    ``words`` keeps hashes of words from text to text. A shingle's hash is made from those of its words.
    """
    import xxhash

    found = raw.lower().split()  # of bytes: lower-cases A-Z, splits at space and the control characters 9 to 13
    if not found:
        return np.zeros(0, np.uint64)
    if len(words) > 1 << 20:
        words.clear()
    for w in found:
        if w not in words:
            words[w] = xxhash.xxh64_intdigest(w)
    hashes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    take = min(shingle, len(found))
    out = np.full(len(found) - take + 1, take, np.uint64)
    for k in range(take):
        out = scramble(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + len(out)])
    return np.unique(out)


def _signer(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, words = Family(), {}
        for batch in batches:
            size, digest, signature, bands = [], [], [], []
            for x in batch.column("text"):
                members = shingle_set(x.as_py() or b"", shingle, words)
                size.append(len(members))
                if not len(members):
                    for column in (digest, signature, bands):
                        column.append(None)
                    continue
                minima = family.minima(members)
                digest.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest())
                signature.append(scramble(minima[:SIGNATURE]).astype(np.uint8).tobytes())
                bands.append(family.band_keys(minima))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "size", "digest", "signature", "bands"])
    return run


def _shingler(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle, words).view(np.int64) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "members"])
    return run


def possible_at(least: float, deviations: int = 6) -> int:
    """Agreeing bytes below which a link is ruled out: so many standard deviations under the mean at the least similarity."""
    return max(1, math.floor(SIGNATURE * least - deviations * math.sqrt(SIGNATURE * least * (1 - least))))


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray], known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Tree edges that connect the positions 0 to ``n - 1``, level by level from the first position not reached.

    ``near(at, others)`` says which of the other positions one is linked with. Every position is compared with all that are not connected with it by then, so the trees are
    the components of all links. Positions of one number in ``known`` are connected from the start, and not compared.
    """
    edges, apart = [], np.arange(n)
    while len(apart) > 1:
        start = apart == apart[0] if known is None else known[apart] == known[apart[0]]
        queue, apart = apart[start].tolist(), apart[~start]
        for at in queue:
            if not len(apart):
                break
            linked = near(at, apart)
            if known is not None and linked.any():
                linked = np.isin(known[apart], known[apart[linked]])
            reached = apart[linked].tolist()
            edges += [(at, x) for x in reached]
            queue += reached
            apart = apart[~linked]
    return edges


def by_signature(signatures: np.ndarray, enough: int) -> Callable[[int, np.ndarray], np.ndarray]:
    return lambda at, others: (signatures[others] == signatures[at]).sum(axis=1) >= enough


def by_sets(members: np.ndarray, sizes: np.ndarray, percent: float, possible: Callable[[int, np.ndarray], np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Whether sets, one after another in ``members``, share enough of their union; those that cannot are not looked at."""
    number = np.unique(members, return_inverse=True)[1]
    first = np.cumsum(sizes) - sizes
    held = np.zeros(int(number.max(initial=-1)) + 1, bool)

    def near(at: int, others: np.ndarray) -> np.ndarray:
        out = possible(at, others) & (100 * np.minimum(sizes[others], sizes[at]) >= percent * np.maximum(sizes[others], sizes[at]))
        some = others[out]
        if len(some):
            own = number[first[at]:first[at] + sizes[at]]
            held[own] = True
            n = sizes[some]
            starts = np.cumsum(n) - n
            shared = np.add.reduceat(held[number[np.repeat(first[some] - starts, n) + np.arange(n.sum())]], starts, dtype=np.int64)
            held[own] = False
            out[out] = 100 * shared >= percent * (n + sizes[at] - shared)
        return out
    return near


def _groups(rows: pa.Table, ends: np.ndarray, enough: int, percent: float | None) -> pa.RecordBatch:
    """Tree edges ``a < b`` of every group of rows: of possible links, or, with ``percent``, of true ones. Where rows have a ``root``, edges are between roots."""
    rows = rows.slice(0, ends[-1])
    rooted = "root" in rows.column_names
    node = rows.column("root" if rooted else "node").to_numpy()
    signatures = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(-1, SIGNATURE)
    size = np.diff(ends)
    found: list[np.ndarray] = []
    if percent is None:
        two = ends[:-1][size == 2]  # most buckets are pairs
        near = (signatures[two] == signatures[two + 1]).sum(axis=1) >= enough
        found.append(np.stack([two[near], two[near] + 1], 1))
        wanted = size > 2
    else:
        lists = rows.column("members").combine_chunks()
        members, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        wanted = size > 1
    for start, n in zip(ends[:-1][wanted].tolist(), size[wanted].tolist()):
        near = by_signature(signatures[start:start + n], enough)
        if percent is not None:
            near = by_sets(members[first[start]:first[start + n]], sizes[start:start + n], percent, near)
        found.append(np.array(forest(n, near, node[start:start + n] if rooted else None), np.int64).reshape(-1, 2) + start)
    pairs = node[np.concatenate(found)] if found else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])


def _trees(enough: int, percent: float | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by ``bucket``; a group may go over into the next batch."""
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            if held[0].column("bucket")[0] == batch.column("bucket")[-1]:
                continue
            rows = pa.concat_tables(held).combine_chunks()
            bucket = rows.column("bucket").to_numpy()
            ends = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
            held = [rows.slice(ends[-1])]
            yield _groups(rows, ends, enough, percent)
        if held:
            rows = pa.concat_tables(held).combine_chunks()
            yield _groups(rows, np.array([0, rows.num_rows]), enough, percent)
    return run


def in_blocks(rows: DataFrame, group: str, *more: str) -> DataFrame:
    """``bucket, node`` and more columns: rows of a group of ``blocks`` blocks, each drawn into one of them and dealt out to the pairs with every other."""
    one = F.pmod(F.xxhash64("node", group), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pairs = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(every, lambda x: x != F.col("block")))
    dealt = rows.withColumn("block", one).withColumn("other", F.explode(pairs))
    bucket = F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other"))
    return dealt.select(bucket.alias("bucket"), "node", *more)


def linked_sets(signed: DataFrame, texts: DataFrame, shingle: int, percent: int, block: int = BLOCK, members: int = MEMBERS) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (one row a distinct set: ``node, digest``) and ``roots`` (``node, root``; nodes without a link are left out)."""
    enough = possible_at(percent / 100)
    distinct = signed.filter("digest IS NOT NULL").dropDuplicates(["digest"])
    # numbers are given in the one write of the table, so they never change
    nodes = stored(distinct.select(F.monotonically_increasing_id().alias("node"), "digest", "key", "size", "signature", "bands"), "minima-nodes")
    signatures = nodes.select("node", "signature")

    placed = nodes.select("node", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", F.ceil(F.col("n") / block).alias("blocks"))
    buckets = in_blocks(placed.join(shared, "band"), "band").join(signatures, "node")
    maybe = buckets.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_trees(enough), "a BIGINT, b BIGINT")
    families = stored(components(maybe), "minima-families")

    sizes = families.union(families.select("root", "root").distinct()).toDF("node", "family").distinct().join(nodes.select("node", "key", "size", "signature"), "node")
    sizes = stored(sizes, "minima-members")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / members))
    wanted = stored(sizes.join(sizes.groupBy("family").agg(blocks.alias("blocks")), "family"), "minima-wanted")
    # how many texts are wanted grows with the input, so they are joined in the same way at every size
    found = texts.join(wanted.select("key", "node").hint("merge"), "key").dropDuplicates(["node"]).select("node", "text")
    sets = stored(found.mapInArrow(_shingler(shingle), "node BIGINT, members ARRAY<BIGINT>"), "minima-sets")
    groups = in_blocks(wanted, "family", "signature").join(sets, "node")
    links = groups.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_trees(enough, percent), "a BIGINT, b BIGINT")
    return nodes, stored(components(links), "minima-roots")


def near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, block: int = BLOCK, members: int = MEMBERS) -> DataFrame:
    """``doc_id, key, n_shingles, component_id, kept`` of every row of ``docs``.

    Rows are linked if their sets of ``shingle`` words share at least ``percent`` hundredths of their union. ``component_id`` is the least
    ``doc_id`` that can be reached over links, itself included; ``kept`` says that it is the row's own; ``key`` is the text's digest.

    A text of fewer words is one shingle of all of them. Null and empty texts, and texts of blanks, have empty sets and are linked with nothing, not with each
    other. A null id takes part with its text; it is a component's id only where all ids are null, and then its rows are kept. Rows repeated with id and text, and rows that
    share an id, are rows of their own. An empty table gives an empty result. Only ids and texts are read.
    """
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = stored(rows.mapInArrow(_signer(shingle), f"doc_id {id_type}, key STRING, size BIGINT, digest BINARY, signature BINARY, bands ARRAY<BIGINT>"), "minima")
    nodes, roots = linked_sets(signed, rows.select("key", "text"), shingle, percent, block, members)
    # the least id of a set first, so that a component has a row a set
    least = signed.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"))
    sets = nodes.select("node", "digest").join(least, "digest").join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    sets = stored(sets, "minima-sets")
    named = sets.join(sets.groupBy("root").agg(F.min("least").alias("named")), "root").select(F.col("digest").alias("of"), "named")
    plain = signed.select("doc_id", "key", F.col("size").alias("n_shingles"), "digest")
    # empty sets stay out of the join, where they would be one key
    found = plain.filter("digest IS NOT NULL").join(named, F.col("digest") == F.col("of")).select("doc_id", "key", "n_shingles", F.col("named").alias("component_id"))
    alone = plain.filter("digest IS NULL").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


by_value(__name__)
