"""Repeated substrings by external induced sorting of sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere. A suffix array of all bytes would take several times the
text on disk, so suffixes are sampled as induced sorting does it, by a local property of the text: of the ``window`` grams in every string of
``length`` bytes, the one with the least hash (the leftmost, if several) is its anchor. Equal strings have equal anchors at equal
places, and an anchor stands for a run of strings, those that begin ``a`` bytes before it, for ``a`` in a range.

Spark's shuffles are the external queues. They carry, in turn, anchors' grams (an anchor whose gram occurs once is done), then the class
of its whole context (an occurrence whose whole context occurs elsewhere is repeated for its whole range), then, for the rest, suffix
tuples: the bytes on both sides. In a task the tuples of a gram are sorted by what follows, with common-prefix values between neighbours, and
the order and these values of the suffixes that begin one byte further left are induced from them, byte by byte,
for all grams of a batch at once: a stable sort by the new first byte, and minima of the old values between rows that become neighbours.
A gram with more than ``group_rows`` different contexts is taken apart into its single strings, which are counted by hash, so no task gets an
unbounded group.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.base import by_value, stored, text_key

GRAM = 32
CHUNK = 1 << 20
POSITION_BITS = 24
DONE, INDUCE, SINGLE, REPRESENT, REPRESENT_SINGLE = range(5)


def _mixer() -> tuple[np.ndarray, list[np.uint64]]:
    """A random number per byte value, and odd factors; the same in every task."""
    words = np.frombuffer(b"".join(hashlib.sha256(b"anchor%d" % i).digest()[:8] for i in range(264)), "<u8")
    return words[:256].copy(), [np.uint64(int(x) | 1) for x in words[256:]]


def gram_hashes(data: np.ndarray, table: np.ndarray, factors: list[np.uint64]) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every position, by doubling."""
    with np.errstate(over="ignore"):
        h, width = table[data], 1
        while width < GRAM:
            h = h[:-width] * factors[width.bit_length() - 1] + h[width:]
            width *= 2
        h ^= h >> np.uint64(32)
        h *= factors[6]
        h ^= h >> np.uint64(29)
    return h


def anchors(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunks: the bytes, and of every anchor its text's number, place in the chunk, first and last string's start, and gram hash; and where texts
    start in the chunk. A long text is taken in overlapping chunks, whose anchors' runs of strings do not overlap."""
    table, factors = _mixer()
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for a in range(0, max(0, len(text) - length + 1), CHUNK):
            part = text[a:a + CHUNK + length - 1]
            if size + len(part) > 2 * CHUNK and parts:
                yield _anchored(parts, length, table, factors)
                parts, size = [], 0
            parts.append((i, a, part))
            size += len(part)
    if parts:
        yield _anchored(parts, length, table, factors)


def _anchored(parts: list[tuple[int, int, bytes]], length: int, table: np.ndarray, factors: list[np.uint64]):
    joined = b"".join(p for _, _, p in parts)
    data = np.frombuffer(joined, np.uint8)
    h = gram_hashes(data, table, factors)
    window, mask = length - GRAM + 1, np.uint64((1 << POSITION_BITS) - 1)
    key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(key) // window)
    padded = np.full(rows * window, np.uint64(2**64 - 1))
    padded[:len(key)] = key
    grid = padded.reshape(rows, window)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    lengths = np.array([len(p) for _, _, p in parts])
    begins = np.cumsum(lengths) - lengths
    strings = lengths - length + 1
    starts = np.repeat(begins - (np.cumsum(strings) - strings), strings) + np.arange(strings.sum())
    place = (np.minimum(backward[starts], forward[starts + window - 1]) & mask).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), strings)
    first = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
    last = np.append(first[1:], len(starts)) - 1
    owner, offset = np.array([i for i, _, _ in parts]), np.array([a for _, a, _ in parts]) - begins
    which = part[first]
    return joined, owner[which], place[first], starts[first], starts[last], h[place[first]].view(np.int64), offset[which]


def _context_hashes(joined: bytes, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """128-bit hashes of contexts, as pairs of integers."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(joined[a:b + length]) for a, b in zip(low.tolist(), high.tolist())]), "<i8").reshape(-1, 2)


def _sampler(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            texts = [x.as_py() or b"" for x in batch.column("text")]
            for joined, owner, place, low, high, gram, _ in anchors(texts, length):
                context = _context_hashes(joined, low, high, length)
                span = (place - high) * 256 + (place - low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks[owner]), pa.array(gram), pa.array(span.astype(np.int32)), pa.array(context[:, 0]), pa.array(context[:, 1])],
                    names=["block", "gram", "span", "u1", "u2"])
    return run


TUPLE = "grp BIGINT, block BIGINT, rid BIGINT, place BIGINT, span INT, context BINARY"
TUPLE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def _gather(length: int, codes: tuple[int, ...]):
    def run(key: tuple, docs: pa.Table, verdicts: pa.Table) -> pa.Table:
        """Of the block's anchors with a verdict in ``codes``: suffix tuples; for those that are done a tuple without bytes."""
        block = key[0].as_py()
        names = [f.split()[0] for f in TUPLE.split(", ")]
        columns: list[list] = [[] for _ in names]
        code_of = dict(zip(zip(*(verdicts.column(c).to_pylist() for c in ("gram", "span", "u1", "u2"))), verdicts.column("code").to_pylist()))
        wanted = np.unique(verdicts.column("gram").to_numpy())
        rids, texts, known = [], [], set()
        for rid, text in zip(docs.column("rid").to_pylist(), docs.column("text")):
            if rid not in known:  # rows that are repeated with their id are one here
                known.add(rid)
                rids.append(rid)
                texts.append(text.as_py() or b"")
        given = set()
        for joined, owner, place, low, high, gram, offset in anchors(texts, length) if len(wanted) else ():
            at = np.searchsorted(wanted, gram)
            hit = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == gram)
            context = _context_hashes(joined, low[hit], high[hit], length)
            span = (place - high) * 256 + (place - low)
            for i, (u1, u2) in zip(hit.tolist(), context.tolist()):
                cls = (int(gram[i]), int(span[i]), u1, u2)
                code = code_of.get(cls)
                if code is None:
                    continue
                rid, p = rids[owner[i]], int(place[i] + offset[i])
                represents = code in (REPRESENT, REPRESENT_SINGLE)
                if (code == DONE or represents) and DONE in codes:
                    row = (hash((rid, p)) & 0x7FFFFFFFFFFFFFFF, block, rid, p, cls[1], None)
                    for c, v in zip(columns, row):
                        c.append(v)
                if code in codes and code != DONE:
                    if represents:
                        if cls in given:
                            continue
                        given.add(cls)
                    # a representative's own strings are done: its tuple is there for the others, and has no place
                    row = (cls[0], block, rid, -1 if represents else p, cls[1], joined[low[i]:high[i] + length])
                    for c, v in zip(columns, row):
                        c.append(v)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, TUPLE_TYPES)})
    return run


def induce(group: np.ndarray, contexts: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """``repeated[i, a]``: whether the string that begins ``a`` bytes before anchor ``i`` is also at another anchor of its group.

    ``low``, ``high``: the range of ``a`` of an anchor; its context holds ``high`` bytes before it and ``length - low`` from it on.
    """
    n, width = len(contexts), int(high.max()) + 1
    repeated = np.zeros((n, width), bool)
    right = [c[h:] for c, h in zip(contexts, high.tolist())]
    left = np.zeros((n, width), np.uint8)
    for i, (c, h) in enumerate(zip(contexts, high.tolist())):
        left[i, :h] = np.frombuffer(c, np.uint8, h)[::-1]
    # suffixes at the anchors, sorted, with common-prefix values: that of a row and the one before
    order = np.array(sorted(range(n), key=lambda i: (group[i], right[i])))
    size = np.array([len(right[i]) for i in order])
    grid = np.zeros((n, length), np.uint8)
    for row, i in enumerate(order):
        grid[row, :size[row]] = np.frombuffer(right[i], np.uint8)
    common = np.zeros(n, np.int64)
    if n > 1:
        differs = grid[1:] != grid[:-1]
        until = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
        common[1:] = np.where(group[order[1:]] == group[order[:-1]], np.minimum(until, np.minimum(size[1:], size[:-1])), 0)
    for a in range(width):
        pairs = np.flatnonzero(common >= length)
        repeated[order[pairs], a] = True
        repeated[order[pairs - 1], a] = True
        alive = np.flatnonzero(high[order] > a)
        if len(alive) < 2 or a + 1 == width:
            break
        members = order[alive]
        turned = np.lexsort((left[members, a], group[members]))
        old, following = alive[turned], members[turned]
        again = np.zeros(len(old), np.int64)
        same = np.flatnonzero((group[following[1:]] == group[following[:-1]]) & (left[following[1:], a] == left[following[:-1], a]))
        if len(same):
            # least value over the rows between two that have become neighbours
            ranges = np.stack([old[same] + 1, old[same + 1] + 1], 1).ravel()
            again[same + 1] = np.minimum.reduceat(np.append(common, 0), ranges)[::2] + 1
        order, common = following, again
    return repeated


def _inducer(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tuples come sorted by group; a group may go over into the next batch."""
        rest = None
        for batch in itertools.chain(batches, [None]):
            part = None if batch is None else pa.Table.from_batches([batch])
            both = rest if part is None else part if rest is None else pa.concat_tables([rest, part])
            if both is None:
                return
            group = both.column("grp").to_numpy()
            cut = len(group) if part is None else int(np.searchsorted(group, group[-1]))
            rest, both, group = both.slice(cut), both.slice(0, cut), group[:cut]
            if not cut:
                continue
            block, rid, place = (both.column(c).to_numpy() for c in ("block", "rid", "place"))
            low, high = np.divmod(both.column("span").to_numpy().astype(np.int64), 256)
            whole = both.column("context").is_null().to_numpy()
            out = [(block[whole], rid[whole], place[whole] - high[whole], place[whole] - low[whole] + length)]
            rows = np.flatnonzero(~whole)
            # whole groups, about as many rows at a time
            edges = np.append(np.flatnonzero(np.diff(group[rows], prepend=group[0] - 1 if cut else 0)), len(rows)) if len(rows) else np.zeros(1, int)
            a = 0
            while a < len(edges) - 1:
                b = a + 1
                while b < len(edges) - 1 and edges[b + 1] - edges[a] <= 20_000:
                    b += 1
                some = rows[edges[a]:edges[b]]
                contexts = both.column("context").take(pa.array(some)).to_pylist()
                found = induce(group[some], contexts, low[some], high[some], length)
                found[place[some] < 0] = False
                steps = np.diff(found.astype(np.int8), axis=1, prepend=0, append=0)
                i, first = np.nonzero(steps == 1)
                _, end = np.nonzero(steps == -1)
                at = some[i]
                out.append((block[at], rid[at], place[at] - (end - 1), place[at] - first + length))
                a = b
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["block", "rid", "start", "stop"])
    return run


def _singles(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The single strings of tuples, by hash."""
        import xxhash

        for batch in batches:
            for row in batch.to_pylist():
                low, high = divmod(row["span"], 256)
                context = row["context"]
                digests = b"".join(xxhash.xxh3_128_digest(context[high - a:high - a + length]) for a in range(low, high + 1))
                w = np.frombuffer(digests, "<i8").reshape(-1, 2)
                n = len(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(np.arange(low, high + 1, dtype=np.int32)), pa.array(np.full(n, row["block"])),
                     pa.array(np.full(n, row["rid"])), pa.array(np.full(n, row["place"]))], names=["w1", "w2", "a", "block", "rid", "place"])
    return run


def _remover(kind: pa.DataType):
    def run(key: tuple, docs: pa.Table, spans: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for rid, start, stop in zip(*(spans.column(c).to_pylist() for c in ("rid", "start", "stop"))):
            by.setdefault(rid, []).append((start, stop))
        out: list[tuple] = []
        for doc_id, rid, text in zip(docs.column("doc_id").to_pylist(), docs.column("rid").to_pylist(), docs.column("text")):
            raw = text.as_py() or b""
            runs: list[list[int]] = []
            for start, stop in sorted(by.get(rid, ())):
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], stop)
                else:
                    runs.append([start, stop])
            edges = [0, *itertools.chain.from_iterable(runs), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((doc_id, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [x for r in runs for x in r]))
        kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(names, kinds))})
    return run


def repeated_bytes(docs: DataFrame, length: int = 200, block_bytes: int = 6_000_000, group_rows: int = 20_000) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed`` of every row; ``removed`` has the starts and ends of the removed runs of bytes.

    A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else, in the same or another row; strings do not cross rows,
    overlaps count, and all strings are judged as the input has them. Null texts are empty, and texts shorter than ``length`` keep all. Rows with
    null or repeated ids are rows like others (a repeated row repeats its text). An empty table gives an empty result; further columns are not looked at.
    """
    if not GRAM < length < GRAM + 256:
        raise ValueError(f"length must be between {GRAM + 1} and {GRAM + 255}")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rid = F.xxhash64("doc_id", text_key(F.col("text")))
    rows = docs.select("doc_id", rid.alias("rid"), F.col("text").cast("binary").alias("text"), F.pmod(rid, F.lit(blocks)).alias("block"))
    sampled = stored(rows.select("block", "text").mapInArrow(_sampler(length), "block BIGINT, gram BIGINT, span INT, u1 BIGINT, u2 BIGINT"), "anchors")
    # stored counts, so that every join below is one of plain shuffles, of which Spark splits large partitions
    often = stored(sampled.groupBy("gram").count().filter("count > 1").select("gram"), "anchor-grams")
    sampled = stored(sampled.join(often, "gram"), "anchors-repeated")
    cls = ["gram", "span", "u1", "u2"]
    classes = sampled.groupBy(*cls).agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("home"))
    classes = stored(classes, "anchor-classes")
    groups = stored(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("n") == 1).alias("lone")).filter("m > 1 AND lone > 0"), "anchor-groups")
    judged = classes.join(groups, "gram", "left")
    small = F.col("m") <= group_rows
    code = (F.when(F.col("m").isNull(), F.lit(DONE)).when(F.col("n") == 1, F.when(small, F.lit(INDUCE)).otherwise(F.lit(SINGLE)))
            .otherwise(F.when(small, F.lit(REPRESENT)).otherwise(F.lit(REPRESENT_SINGLE))))
    judged = stored(judged.filter("n > 1 OR m IS NOT NULL").select(*cls, code.alias("code"), "home"), "anchor-verdicts")
    # of a class one row per block, however many copies of it there are
    asked = sampled.select("block", *cls).distinct()
    verdicts = asked.join(judged, cls).select("block", *cls, F.when(
        F.col("code").isin(REPRESENT, REPRESENT_SINGLE) & (F.col("block") != F.col("home")), F.lit(DONE)).otherwise(F.col("code")).alias("code"))
    verdicts = stored(verdicts, "anchor-verdicts")

    dealt = rows.groupBy("block")
    tuples = dealt.cogroup(verdicts.groupBy("block")).applyInArrow(_gather(length, (DONE, INDUCE, REPRESENT)), TUPLE)
    spans = tuples.repartition("grp").sortWithinPartitions("grp").mapInArrow(_inducer(length), "block BIGINT, rid BIGINT, start BIGINT, stop BIGINT")
    if verdicts.filter(F.col("code") == SINGLE).limit(1).count():
        large = verdicts.filter(F.col("code").isin(SINGLE, REPRESENT_SINGLE))
        tuples = dealt.cogroup(large.groupBy("block")).applyInArrow(_gather(length, (SINGLE, REPRESENT_SINGLE)), TUPLE)
        strings = stored(tuples.mapInArrow(_singles(length), "w1 BIGINT, w2 BIGINT, a INT, block BIGINT, rid BIGINT, place BIGINT"), "strings")
        twice = stored(strings.groupBy("w1", "w2", "a").count().filter("count > 1").drop("count"), "strings-repeated")
        found = strings.filter("place >= 0").join(twice, ["w1", "w2", "a"])
        spans = spans.unionByName(found.select("block", "rid", (F.col("place") - F.col("a")).alias("start"), (F.col("place") - F.col("a") + length).alias("stop")))
    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"doc_id {kind.simpleString()}, n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, kept_sha256 STRING, removed ARRAY<BIGINT>"
    return rows.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_remover(to_arrow_type(kind)), schema)


by_value(__name__)
