"""Document fingerprints from Lempel-Ziv phrases.

A text is cut into dictionary phrases (LZ78: each the shortest that is not in the dictionary yet), the set of phrases is hashed, and the
least hashes are its signature. Texts that compress well together share phrases, so the share of common least hashes is a
compression-like similarity. A phrase's hash comes from prefix sums of the text, so phrases are hashed all at once.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.base import by_value, stored, text_key

BASE = 0x9E3779B97F4A7C15 | 1
FULL = 1 << 20  # phrases after which the dictionary starts anew, so that its memory is bounded
HASHES = 64


def parse(text: str, start: int, seen: set[str], ends: list[int]) -> None:
    """Ends of the phrases from ``start`` on. A dictionary holds the prefixes of all it holds, so the search starts at the last length."""
    n, s, guess, add, push = len(text), start, 4, seen.add, ends.append
    room = FULL - len(seen)
    while s < n:
        e = min(s + guess, n)
        piece = text[s:e]
        if piece in seen:
            while e < n:
                e += 1
                piece = text[s:e]
                if piece not in seen:
                    break
        else:
            while e > s + 1:
                shorter = text[s:e - 1]
                if shorter in seen:
                    break
                piece, e = shorter, e - 1
        add(piece)
        push(e)
        guess = e - s
        s = e
        room -= 1
        if not room:
            seen.clear()
            room = FULL


class Hasher:
    """Signatures of phrase sets; powers of the base are kept from text to text."""

    def __init__(self):
        self._powers(1 << 12)

    def _powers(self, n: int) -> None:
        inverse = pow(BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]), dtype=np.uint64)

    def signature(self, text: str, ends: list[int]) -> np.ndarray:
        """The ``HASHES`` least different 32-bit hashes of the phrases, ascending."""
        n = len(text)
        if not n:
            return np.zeros(0, np.uint32)
        if n >= len(self.up):
            self._powers(2 * n)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * self.up[:n], dtype=np.uint64)])
            e = np.array(ends)
            s = np.concatenate([[0], e[:-1]])
            h = (sums[e] - sums[s]) * self.down[s] + (e - s).astype(np.uint64)
            h ^= h >> np.uint64(30)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(27)
            h *= np.uint64(0x94D049BB133111EB)
            h >>= np.uint64(32)
        h = h.astype(np.uint32)
        most = 4 * HASHES
        if len(h) > 8 * most:  # phrases may repeat after the dictionary was full: then more are looked at
            least = np.unique(np.partition(h, most)[:most])
            if len(least) > HASHES:
                return least[:HASHES]
        return np.unique(h)[:HASHES]


def pair(text: str, following: str, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of a text and of its edited text, and the latter: its last half replaced by as much of the following text."""
    seen: set[str] = set()
    ends: list[int] = []
    parse(text, 0, seen, ends)
    cut = len(text) - len(text) // 2
    edited = text[:cut] + following[:len(text) // 2]
    same = bisect.bisect_right(ends, cut)  # phrases that end in the common part are the same
    start = ends[same - 1] if same else 0
    other = ends[:same]
    if len(ends) < FULL:
        # the dictionary as it was there: the last phrase alone may have been in it before
        edges = [start, *ends[same:]]
        later = [text[a:b] for a, b in zip(edges, edges[1:])]
        if later:
            last = later.pop()
            earlier = ends[:-1]
            known = any(b - a == len(last) and text[a:b] == last for a, b in zip([0, *earlier], earlier))
            seen.difference_update(later)
            if not known:
                seen.discard(last)
        parse(edited, start, seen, other)
    else:
        other = []
        parse(edited, 0, set(), other)
    return hasher.signature(text, ends), hasher.signature(edited, other), edited


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases: of the least hashes of both, those that both have. Two empty texts are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = set(a.tolist()), set(b.tolist())
    least = sorted(x | y)[:HASHES]
    return sum(h in x and h in y for h in least) / len(least)


def written(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def _fingerprinter(kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come bucket by bucket in order, the guest that follows a bucket's last row at its end."""
        hasher, names = Hasher(), ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None  # bucket, id, text, signatures that wait for the next row

        def row(doc_id, text: str, following: str) -> tuple:
            own, changed, edited = pair(text, following, hasher)
            return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed

        out, waiting = [], None
        for batch in batches:
            columns = [batch.column(c) for c in ("bucket", "guest", "doc_id", "text")]
            for i in range(batch.num_rows):
                bucket, guest, doc_id = (c[i].as_py() for c in columns[:3])
                raw = columns[3][i].as_py()
                text = raw.decode("utf-8", "replace") if raw else ""
                if held and held[0] == bucket:
                    done = row(held[1], held[2], text)
                    if waiting:
                        out.append((*waiting, likeness(waiting[3], done[3])))
                    waiting = done
                    if guest:  # the bucket's last row is done: only the guest's signature is wanted
                        ends: list[int] = []
                        parse(text, 0, set(), ends)
                        out.append((*waiting, likeness(waiting[3], hasher.signature(text, ends))))
                        held = waiting = None
                        continue
                elif guest:
                    continue  # a repeated guest
                held = (bucket, doc_id, text)
                if len(out) >= 2_000:
                    yield _batch(out, kinds, names)
                    out = []
        if out:
            yield _batch(out, kinds, names)
    return run


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    ids, n, sha, own, changed, nearer = zip(*rows)
    values = [ids, n, sha, [written(x) for x in own], [written(x) for x in changed], [likeness(x, y) for x, y in zip(own, changed)], nearer]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)


def _bucketer(firsts: list[tuple]):
    """Bucket of a row among those whose first rows are given, in descending order; and, for a first row, the bucket before."""
    bounds = [(x is not None, x, key) for x, key in reversed(firsts)]
    last = len(firsts) - 1

    @F.pandas_udf("bucket INT, before INT")
    def bucket(ids: pd.Series, keys: pd.Series) -> pd.DataFrame:
        own, before = [], []
        for x, key in zip(ids.tolist(), keys.tolist()):
            at = (True, int(x), key) if x is not None and x == x else (False, None, key)
            place = bisect.bisect_left(bounds, at)
            first = place <= last and bounds[place] == at
            b = last - place  # the last bound that is not below the row
            own.append(b)
            before.append((b - 1) % len(bounds) if first else -1)
        return pd.DataFrame({"bucket": own, "before": before})
    return bucket


def fingerprints(docs: DataFrame, part_chars: int = 4_000_000, most_parts: int = 20_000) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text has the last half (rounded down) of a row's code points replaced by as many, or all, of the next row's first; rows follow one another by descending
    ``doc_id`` (a whole number; nulls last), then descending digest of the text, and after the last comes the first. ``near_*``: how alike the row's
    fingerprint is to that of its edited text and of the next row. Null texts are empty; an empty text's fingerprint is empty, and it is
    alike to empty texts only. Repeated rows follow one another. An empty table gives an empty result; further columns are not looked at.
    Rows go once through a shuffle, in ranges of about ``part_chars``, and only the first row of each range twice.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text_key(F.col("text")), F.lit("")).alias("key"), F.col("text").cast("binary").alias("text"))
    narrow = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text_key(F.col("text")), F.lit("")).alias("key"),
                                F.coalesce(F.length("text"), F.lit(0)).alias("n")), "fingerprint-order")
    total = narrow.agg(F.sum("n")).first()[0] or 0
    parts = min(max(1, -(-total // part_chars)), most_parts)
    ranged = narrow.repartitionByRange(parts, F.desc_nulls_last("doc_id"), F.desc("key"))
    # of a range one row: as many as there are ranges
    firsts = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.max(F.struct("doc_id", "key")).alias("first")).collect()
    firsts = sorted({(r.first.doc_id, r.first.key) for r in firsts}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    id_kind = docs.schema["doc_id"].dataType
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = "doc_id BIGINT, n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, edited_fingerprint STRING, near_edited DOUBLE, near_next DOUBLE"
    if not firsts:
        return docs.sparkSession.createDataFrame([], schema).withColumn("doc_id", F.col("doc_id").cast(id_kind))
    placed = keyed.withColumn("place", _bucketer(firsts)("doc_id", "key"))
    own = F.struct(F.col("place.bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.when(F.col("place.before") >= 0, F.array(own, F.struct(F.col("place.before").alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    dealt = placed.withColumn("to", F.explode(guest)).select("to.bucket", "to.guest", "doc_id", "key", "text")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), F.desc("key"))
    out = ordered.mapInArrow(_fingerprinter(kinds), schema)
    return out if isinstance(id_kind, T.LongType) else out.withColumn("doc_id", F.col("doc_id").cast(id_kind))


by_value(__name__)
