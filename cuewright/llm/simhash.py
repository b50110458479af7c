"""Near duplicates by SimHash: a binary trie joined with itself within a budget of differing bits.

Two fingerprints that differ in at most ``budget`` of 64 bits agree in ``segments - budget`` of ``segments`` pieces of the
fingerprint. So one trie is made for each choice of that many pieces, with the chosen bits first. The join goes down
pairs of its nodes. On the chosen bits no difference is allowed, so only a node and itself go on, and this part is a hash
partitioning by those bits. Below, a pair of nodes carries the bits that differ so far, and is dropped when they exceed the
budget. Pairs of nodes with few rows are compared in a task; those with many are taken further down by
Spark, all over the cluster, with rows that are already connected through a pivot left out against each other.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.base import by_value, columns, fresh, same, stored, text_key

BITS = 64


def shingle_hashes(raw: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words of a UTF-8 text; of all words if they are fewer, of none if there are none."""
    import xxhash

    words = raw.lower().split()  # of bytes: lower-cases A-Z, splits at space and the control characters 9 to 13
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], "<u8")
    starts = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    return np.array([digest(joined[a:b - 1], seed) for a, b in zip(starts, starts[shingle:])], "<u8")


def fingerprint(raw: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text: bit set where over half the shingles' XXH64 have it."""
    return fingerprint_of(shingle_hashes(raw, shingle, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of shingles by their hashes, repeats included."""
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 4096):
        block = hashes[a:a + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprinter(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            out = np.array([fingerprint(x.as_py() or b"", shingle) for x in text], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(out)], names=["doc_id", "key", "fp"])
    return run


def connect(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least connected position of every position: hooking and pointer jumping over arrays."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return label
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def _join_groups(group: np.ndarray, fp: np.ndarray, side: np.ndarray, known: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is within budget in each group of sorted rows; side 2 is a node paired with itself."""
    n = len(fp)
    label, waiting, held = np.arange(n), [], 0
    live = np.arange(n)
    step = 1
    while len(live):
        live = live[live + step < n]
        live = live[group[live] == group[live + step]]
        if not len(live):
            break
        other = live + step
        near = np.bitwise_count(fp[live] ^ fp[other]) <= budget
        near &= (side[live] == 2) | (side[live] != side[other])
        near &= ~(known[live] & known[other])
        if near.any():
            waiting.append((live[near], other[near]))
            held += len(waiting[-1][0])
            if held > 500_000:
                label, waiting, held = connect(n, *map(np.concatenate, zip(*waiting)), label), [], 0
        step += 1
    if waiting:
        label = connect(n, *map(np.concatenate, zip(*waiting)), label)
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def _leaf_join(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by node; a node's rows may go over into the next batch."""
        rest = None
        for batch in itertools.chain(batches, [None]):
            part = None if batch is None else pa.Table.from_batches([batch])
            both = rest if part is None else part if rest is None else pa.concat_tables([rest, part])
            if both is None:
                return
            node = both.column("node").to_numpy()
            cut = len(node) if part is None else int(np.searchsorted(node, node[-1]))
            rest = both.slice(cut)
            done = both.slice(0, cut)
            if not cut:
                continue
            edges = _join_groups(done.column("node").to_numpy(), done.column("fp").to_numpy().view(np.uint64), done.column("side").to_numpy(),
                                 done.column("known").to_numpy().astype(bool), budget)
            if len(edges[0]):
                yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)) for e in edges], names=["a", "b"])
    return run


def _cuts(segments: int) -> list[tuple[int, int]]:
    edges = [BITS * i // segments for i in range(segments + 1)]
    return list(zip(edges, edges[1:]))


def _chosen_first(fp: Column, cuts: list[tuple[int, int]], chosen: tuple[int, ...]) -> tuple[Column, Column, int]:
    """The chosen bits, the other bits, and how many the latter are."""
    def gather(which: list[int]) -> tuple[Column, int]:
        value, width = F.lit(0).cast("long"), 0
        for i in which:
            a, b = cuts[i]
            piece = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
            value, width = F.shiftleft(value, b - a).bitwiseOR(piece), width + b - a
        return value, width
    head, _ = gather(list(chosen))
    tail, width = gather([i for i in range(len(cuts)) if i not in chosen])
    return head, tail, width


def near_links(fingerprints: DataFrame, budget: int = 4, leaf_rows: int = 2_048, count: int | None = None) -> DataFrame:
    """``a, b``: pairs of different ``fp`` that connect all fingerprints linked within ``budget`` bits, directly or over others.

    ``fingerprints``: a column ``fp BIGINT`` of distinct values. Not every link is a row: in each node pair only a forest of
    the links is given, so that a group of copies costs as many rows as it has members.
    """
    n = fingerprints.count() if count is None else count
    segments = budget + 1
    while BITS * (segments - budget) // segments < BITS // 2 and n >> (BITS * (segments - budget) // segments) > 64:
        segments += 1
    cuts = _cuts(segments)
    choices = []
    for number, chosen in enumerate(itertools.combinations(range(segments), segments - budget)):
        head, tail, width = _chosen_first(F.col("fp"), cuts, chosen)
        choices.append(F.struct(F.lit(number).alias("trie"), head.alias("head"), tail.alias("tail"), F.lit(width).alias("width")))
    rows = fingerprints.select("fp", F.explode(F.array(*choices)).alias("t")).select("fp", "t.*")
    node = F.xxhash64("trie", "head")
    sizes = rows.groupBy("trie", "head").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("pivot")).filter("n > 1")
    large = sizes.filter(F.col("n") > leaf_rows).limit(1).count() > 0
    small = rows.join(sizes.filter(F.col("n") <= leaf_rows).select("trie", "head"), ["trie", "head"], "left_semi") if large else rows
    leaves = small.select(node.alias("node"), F.lit(2).cast("byte").alias("side"), F.lit(False).alias("known"), "fp")
    links = None
    if large:
        hot = rows.join(sizes.filter(F.col("n") > leaf_rows), ["trie", "head"])
        hot = hot.withColumn("known", F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= budget)
        hot = stored(hot.withColumn("depth", F.lit(0)).withColumn("pa", F.lit(0).cast("long")).withColumn("pb", F.lit(0).cast("long"))
                     .withColumn("diff", F.lit(0)).withColumn("side", F.lit(2).cast("byte")), "trie")
        links = hot.filter("known AND fp != pivot").select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
        for part in _descend(hot.drop("n", "pivot"), budget, leaf_rows):
            leaves = leaves.unionByName(part)
    # a partition's rows in node order; nodes are small, so equal partitions are in reach
    by_node = leaves.repartition("node").sortWithinPartitions("node", "fp")
    found = by_node.mapInArrow(_leaf_join(budget), "a BIGINT, b BIGINT")
    return found if links is None else found.unionByName(links)


def _descend(rows: DataFrame, budget: int, leaf_rows: int, bits: int = 4) -> Iterator[DataFrame]:
    """Node pairs taken down ``bits`` levels at a time until each has few rows; yields those that do, as leaves."""
    pair = ["trie", "head", "depth", "pa", "pb", "diff"]
    while True:
        taken = F.least(F.lit(bits), F.col("width") - F.col("depth"))  # the last step may have fewer levels
        nibble = F.call_function("shiftrightunsigned", "tail", F.col("width") - F.col("depth") - taken)
        present = rows.withColumn("nibble", nibble.bitwiseAND(F.call_function("shiftleft", F.lit(1), taken) - 1).cast("int"))
        mask = lambda side: F.coalesce(F.bit_or(F.when(F.col("side") == side, F.call_function("shiftleft", F.lit(1), F.col("nibble")))), F.lit(0))
        sizes = present.groupBy(*pair).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(~F.col("known")).alias("fresh"), mask(0).alias("m0"), mask(1).alias("m1"), mask(2).alias("m2"))
        # a pair in which one node is empty, or all rows are connected already, has nothing to find
        sizes = stored(sizes.filter("fresh > 0 AND n > 1 AND (m2 > 0 OR (m0 > 0 AND m1 > 0))"), "trie-sizes")
        few = rows.join(sizes.filter(F.col("n") <= leaf_rows).select(*pair), pair, "left_semi")
        yield few.select(F.xxhash64(*pair).alias("node"), "side", "known", "fp")
        many = sizes.filter(F.col("n") > leaf_rows).drop("n", "fresh")
        if not many.limit(1).count():
            return
        down = present.join(many, pair)
        # partners of a row: nibbles present on the other side, within what is left of the budget
        others = F.when(F.col("side") == 0, F.col("m1")).when(F.col("side") == 1, F.col("m0")).otherwise(F.col("m2"))
        partner = F.filter(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda y: (F.call_function("shiftright", others, y).bitwiseAND(1) == 1)
                           & (F.bit_count(F.col("nibble").bitwiseXOR(y)) + F.col("diff") <= budget))
        down = down.withColumn("partner", F.explode(partner))
        x, y, side = F.col("nibble"), F.col("partner"), F.col("side")
        alone = (side == 2) & (x == y)
        first = F.when(side == 2, x < y).otherwise(side == 0)
        a, b = F.when(first, x).otherwise(y), F.when(first, y).otherwise(x)
        rows = stored(down.select(
            "trie", "head", "tail", "width", "fp", "known", F.least(F.col("depth") + bits, F.col("width")).alias("depth"),
            F.shiftleft("pa", bits).bitwiseOR(a.cast("long")).alias("pa"), F.shiftleft("pb", bits).bitwiseOR(b.cast("long")).alias("pb"),
            (F.col("diff") + F.bit_count(x.bitwiseXOR(y))).alias("diff"),
            F.when(alone, F.lit(2)).when(first, F.lit(0)).otherwise(F.lit(1)).cast("byte").alias("side")), "trie")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: of every node of the edges ``a, b`` the least node it is connected with.

    Alternates large and small stars until nothing changes, a number of rounds that grows with the logarithm of the
    longest path. Minima are combined before the shuffle and stored, so that the joins are of plain shuffles, whose large partitions Spark splits.
    """
    edges = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    state = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "stars")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "stars")
        small = large.join(least, "a")
        edges = stored(small.select("b", "m").union(least.select("a", "m")).toDF("a", "b").filter("a != b").distinct(), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.toDF("node", "root")
        state = now


def near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4, leaf_rows: int = 2_048) -> DataFrame:
    """``doc_id, key, fp, component_id, root`` of every row; ``key`` is the text's digest, ``component_id`` the least ``doc_id`` that can
    be reached over links of at most ``budget`` differing bits, ``root`` the least fingerprint there.

    Null and empty texts, and texts of blanks, have fingerprint zero, linked like any other. A null ``doc_id`` takes part with its text
    but is no component's id, unless all ids of the component are null. Repeated rows are in one component. An empty
    table gives an empty result. Only ids and texts are read.
    """
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    prints = stored(rows.mapInArrow(_fingerprinter(shingle), f"doc_id {id_type}, key STRING, fp BIGINT"), "simhash")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(near_links(nodes.select("fp"), budget, leaf_rows))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(named, "root").select("fp", "component_id", "root")
    return prints.join(named, "fp").select("doc_id", "key", "fp", "component_id", "root")


def without_near_duplicates(docs: DataFrame, groups: Callable[..., DataFrame] = near_duplicates, **settings) -> DataFrame:
    """One document of each group of near duplicates, columns as they are: that with the least ``doc_id`` (a null is last, then the text's
    digest decides). Of rows that are repeated with id and text, one stays. ``groups(docs, **settings)`` gives ``doc_id, key, root``."""
    labels = stored(groups(docs, **settings), "near-duplicates")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    kept = labels.groupBy("root").agg(F.min(first).alias("first")).select(
        F.col("first.doc_id").alias("kept_id"), F.col("first.key").alias("kept_key"))
    key, = fresh(docs, "text_key")
    keyed = docs.withColumn(key, text_key(F.col("text")))
    out = keyed.join(kept, same(keyed, kept, [("doc_id", "kept_id"), (key, "kept_key")]), "left_semi")
    if labels.groupBy("doc_id", "key").count().filter("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", key])
    return out.select(*columns(out, docs.columns))


by_value(__name__)
