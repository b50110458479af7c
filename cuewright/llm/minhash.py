"""Near duplicates by the shingles they share: the SimHash trie and MinHash bands propose pairs, the exact similarity of the shingle sets decides.

The trie of ``simhash`` links fingerprints that differ in few bits. Of texts that share 0.8 of their shingles these are the closest; the bands find the others.

A pair of texts of similarity ``s`` (shared shingles by all shingles of the two) agrees in a band of ``ROWS`` minima with probability
``s ** ROWS``, and in one of ``BANDS`` at least with ``1 - (1 - s ** ROWS) ** BANDS``: 0.9998 at 0.8, over 0.9999999 at 0.9. In a bucket of texts that agree
in a band, each is first compared with one of them, so a large group of copies costs as many pairs as it has members. What these links leave apart is
compared in tasks, as in ``universal_minima``: by signatures in a bucket, which makes families of what may be alike, then by the full sets of a family. Texts that are connected already are not compared
with one another, only tree edges leave a task, and no pair of texts is a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.base import by_value, stored, text_key
from cuewright.llm.simhash import components, fingerprint_of, near_links, shingle_hashes
from cuewright.llm.universal_minima import BLOCK, MEMBERS, SIGNATURE, _trees, possible_at, scramble

BANDS, ROWS = 48, 8


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of the hashes under each of ``BANDS * ROWS`` mappings; all ones for no hashes."""
    rng = np.random.default_rng(1)
    turn, odd = rng.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
    odd |= np.uint64(1)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for a in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[None, a:a + 1024] ^ turn) * odd).min(axis=1))
    return least


def _signer(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every text the number of its shingles, its SimHash, a byte of each of the first minima and a hash of each band."""
        import xxhash

        for batch in batches:
            size, prints, bytes_, bands = [], [], [], []
            for x in batch.column("text"):
                every = shingle_hashes(x.as_py(), shingle)
                prints.append(fingerprint_of(every))
                hashes = np.unique(every)
                minima = signature(hashes)
                raw = minima.astype("<u8").tobytes()
                size.append(len(hashes))
                bytes_.append(scramble(minima[:SIGNATURE]).astype(np.uint8).tobytes())
                bands.append(np.array([xxhash.xxh64_intdigest(raw[8 * ROWS * i:8 * ROWS * (i + 1)], i) for i in range(BANDS)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("node"), pa.array(size, pa.int32()),
                                              pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(bytes_, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                                             names=["doc_id", "key", "node", "size", "fp", "signature", "bands"])
    return run


def _shingler(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), shingle)).view(np.int64) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])
    return run


def _sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``node, set``: the shingles of the texts that are wanted."""
    rows = texts.join(wanted, "node", "left_semi").dropDuplicates(["node"])
    return stored(rows.mapInArrow(_shingler(shingle), "node BINARY, set ARRAY<BIGINT>"), "shingles")


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Of the pairs ``a, b`` those whose texts are similar enough, by their shingle sets."""
    sets = _sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingle)
    both = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(shared >= least * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def _trie_pairs(signed: DataFrame, budget: int) -> DataFrame:
    """``a, b``: texts that the SimHash trie links, each fingerprint by one of its texts, and with that one the others of the same fingerprint."""
    texts = signed.select("fp", "node").distinct()
    prints = stored(texts.groupBy("fp").agg(F.min("node").alias("first")), "simhash-nodes")
    same = texts.join(prints, "fp").filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = stored(near_links(prints.select("fp"), budget).select("a", "b").distinct(), "simhash-links")
    ends = links.join(prints.toDF("a", "text_a"), "a").join(prints.toDF("b", "text_b"), "b")
    return same.union(ends.select("text_a", "text_b"))


def _dealt(rows: DataFrame, group: str, block: int, members: int) -> DataFrame:
    """``bucket, node, root, signature`` such that rows of a ``group`` that differ in ``root`` meet in a bucket of about two blocks.

    The rows of the most frequent root are cut into blocks, and so are the others. Each block of others is paired with every block; blocks of the first are not paired with one another, since their
    rows are connected. So the copies of rows grow with the comparisons that are wanted, and not with the square of a group that is connected but for a few.
    """
    blocks = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / members))
    counts = rows.groupBy(group, "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    counts = counts.groupBy(group).agg(F.max(F.struct("n", "size", "root")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size")).filter("n > main.n")
    counts = counts.select(group, F.col("main.root").alias("main"), blocks(F.col("main.n"), F.col("main.size")).alias("mains"),
                           blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("others"))
    is_main, draw = F.col("root") == F.col("main"), F.xxhash64("node", group)
    own = F.when(is_main, F.col("others") + F.pmod(draw, F.col("mains"))).otherwise(F.pmod(draw, F.col("others")))
    end = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    dealt = rows.join(counts, group).withColumn("block", own).withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), end - 1))).filter("block != partner")
    bucket = F.xxhash64(group, F.least("block", "partner"), F.greatest("block", "partner"))
    return dealt.select(bucket.alias("bucket"), "node", "root", "signature")


def _links_between(apart: DataFrame, signed: DataFrame, texts: DataFrame, shingle: int, least: float, block: int, members: int) -> DataFrame:
    """``a, b``: roots that links between their texts connect, directly or over others; a forest of them in each task. ``apart``: ``band, node, size, root``, the texts of buckets that hold several roots.

    Signatures rule out what has nine standard deviations fewer equal minima than texts of similarity ``least`` (at 0.8 a link is lost so with probability 1e-16, computed from the method).
    What they leave makes families, in which all are compared, whether they share a band or not.
    """
    enough = possible_at(least, 9)
    in_order = lambda rows: rows.repartition("bucket").sortWithinPartitions("bucket", "node")
    # numbers are given in the one write of the table, so they never change
    roots = stored(apart.select("root").distinct().select(F.monotonically_increasing_id().alias("number"), F.col("root").alias("name")), "minhash-roots")
    nodes = apart.select("node", "size", "root").distinct().join(roots, F.col("root") == F.col("name")).select("node", "size", F.col("number").alias("root"))
    nodes = stored(nodes.join(signed.select("node", "signature").dropDuplicates(["node"]), "node"), "minhash-nodes")
    placed = stored(apart.select("band", "node").join(nodes, "node"), "minhash-placed")
    maybe = in_order(_dealt(placed, "band", block, 1 << 62)).mapInArrow(_trees(enough), "a BIGINT, b BIGINT")
    families = components(maybe)
    families = stored(families.union(families.select("root", "root")).distinct().toDF("number", "family"), "minhash-families")
    wanted = stored(nodes.join(families, nodes["root"] == families["number"]).select("node", "size", "root", "signature", "family"), "minhash-wanted")
    sets = _sets(texts, wanted.select("node"), shingle).toDF("node", "members")
    groups = _dealt(wanted, "family", block, members).join(sets, "node")
    links = in_order(groups).mapInArrow(_trees(enough, 100 * least), "a BIGINT, b BIGINT").filter("a != b").distinct()
    return links.join(roots.toDF("a", "root_a"), "a").join(roots.toDF("b", "root_b"), "b").select("root_a", "root_b")


def similar_documents(docs: DataFrame, shingle: int = 5, least: float = 0.8, budget: int = 4, block: int = BLOCK, members: int = MEMBERS) -> DataFrame:
    """``doc_id, key, root`` of every row; rows have one ``root`` if they are connected over pairs of texts whose sets of ``shingle`` words have at least
    ``least`` of their shingles in common. ``key`` is the text's digest. Pairs are proposed by the trie of fingerprints within ``budget`` bits, and by bands.

    Words are as in ``simhash``. A text of fewer words is one shingle; null and empty texts, and texts of blanks, are copies of one another. Rows with null
    ids take part like others. An empty table gives an empty result. Only ids and texts are read.
    """
    filled = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.unhex(F.md5(filled)).alias("node"), filled.cast("binary").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = stored(rows.mapInArrow(_signer(shingle), f"doc_id {id_type}, key STRING, node BINARY, size INT, fp BIGINT, signature BINARY, bands ARRAY<BIGINT>"), "minhash")
    texts = rows.select("node", "text")
    banded = signed.dropDuplicates(["node"]).select("node", "size", F.explode("bands").alias("band"))
    banded = stored(banded, "minhash-bands")
    shared = stored(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size")).alias("pivot")).filter("n > 1"), "minhash-pivots")
    banded = stored(banded.join(shared, "band").select("band", "node", "size", "pivot"), "minhash-buckets")
    alike = lambda a, b: F.least(a, b) >= least * F.greatest(a, b)
    first = banded.filter((F.col("node") != F.col("pivot.node")) & alike(F.col("size"), F.col("pivot.size")))
    first = first.select(F.col("pivot.node").alias("a"), F.col("node").alias("b")).union(_trie_pairs(signed, budget))
    first = stored(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    links = stored(_similar(first, texts, shingle, least), "minhash-links")
    roots = components(links)
    # what is still apart in a bucket
    apart = banded.join(roots, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
    apart = stored(apart, "minhash-apart")
    mixed = apart.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band")
    apart = stored(apart.join(mixed, "band", "left_semi"), "minhash-apart")
    if apart.limit(1).count():
        # stars of what is connected, in place of the links that made them
        roots = components(roots.toDF("a", "b").union(_links_between(apart, signed, texts, shingle, least, block, members)))
    return signed.join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))


by_value(__name__)
