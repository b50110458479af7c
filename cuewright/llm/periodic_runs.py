"""Periodic runs of words, found with a dictionary of basic factors.

The basic factors of a text are its stretches of 1, 2, 4, ... words; equal ones have one name, and names of a length come from pairs of names of half
of it. The successor of a position is the next place where its factor occurs again. A run of least period ``q`` that is at least three
periods long has, for the factor length ``L`` with ``L / 2 < q <= L``, successors exactly ``q`` further at all its positions but the last ``q + L - 1``: a nearer
occurrence would give the run a shorter period. Both occurrences lie within twice the factor's length. So positions that follow
one another with the same distance to their successors, in arithmetic progression, propose a period; the stretch from the first of them to
the end of the last one's successor is extended while the words go on in that period, and proposals that become the same run are one.

Many texts are worked on at once. A position whose factor does not occur again leaves the work, so longer factors cost only what repeats.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.base import by_value, fresh, text_key

BLANK = r"[\x20\x09-\x0D]+"
WORDS = 1 << 19  # words after which a task works off the texts it holds


def successors(names: np.ndarray) -> np.ndarray:
    """Of every place the next one with the same name; the length where there is none."""
    order = np.argsort(names, kind="stable")
    out = np.full(len(names), len(names))
    again = names[order[1:]] == names[order[:-1]]
    out[order[:-1][again]] = order[1:][again]
    return out


def _numbered(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1]


def proposals(words: np.ndarray, text: np.ndarray, left: np.ndarray, whole: np.ndarray, periods: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``start, end, period`` of stretches with successors at one distance, by factor length.

    ``words`` are numbers, ``text`` the text each belongs to, ``left`` how many words that text has from there on, ``whole`` how many it has.
    """
    place = np.arange(len(words))
    name = _numbered(text, words)
    name_at = np.full(len(words), -1)
    length = 1
    while len(place):
        after = successors(name)
        here = np.flatnonzero(after < len(place))
        distance = place[after[here]] - place[here]
        # nearer and farther ones belong to other lengths
        fits = (2 * distance > length) & (distance <= length)
        at, step = place[here[fits]], distance[fits]
        if len(at):
            opens = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(step) != 0)]))
            closes = np.concatenate([opens[1:], [len(at)]]) - 1
            yield at[opens], at[closes] + step[opens] + length, step[opens]
        # a longer factor occurs again only if both of its halves do, and its text must hold a run of its periods
        again = np.zeros(len(place), bool)
        again[here] = again[after[here]] = True
        place, name = place[again], name[again]
        name_at[:] = -1
        name_at[place] = name
        half, length = length, 2 * length
        second = name_at[np.minimum(place + half, len(words) - 1)]
        goes_on = (left[place] >= length) & (second >= 0) & (whole[place] >= periods * (half + 1))
        place, name = place[goes_on], _numbered(name[goes_on], second[goes_on])


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = 6, periods: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, length, period`` of all runs of texts that stand one after another, in order of text, start and period.

    A run is a stretch of at least ``least`` words and ``periods`` periods (3 or more) with the least period ``period``, which no neighbouring word goes on with.
    """
    if periods < 3:
        raise ValueError("runs of less than three periods are not found this way")
    first = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(first + sizes, sizes) - np.arange(len(words))
    found: set[tuple[int, int, int, int]] = set()
    for starts, ends, steps in proposals(words, text, left, np.repeat(sizes, sizes), periods):
        long_enough = ends - starts >= periods * steps
        for start, end, step in zip(starts[long_enough].tolist(), ends[long_enough].tolist(), steps[long_enough].tolist()):
            t = int(text[start])
            low, high = int(first[t]), int(first[t] + sizes[t])
            while start > low and words[start - 1] == words[start - 1 + step]:
                start -= 1
            while end < high and words[end] == words[end - step]:
                end += 1
            if end - start >= least:
                found.add((t, start - low, end - start, step))
    runs = np.array(sorted(found, key=lambda r: (r[0], r[1], r[3])), np.int64).reshape(-1, 4)
    return runs[:, 0], runs[:, 1], runs[:, 2], runs[:, 3]


def _finder(least: int, periods: int, room: int):
    def work(rows: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        sizes = np.array([len(t) for t in texts], np.int64)
        words = np.fromiter((number[w] for t in texts for w in t), np.int64, int(sizes.sum()))
        text, start, length, period = runs_of(words, sizes, least, periods)
        edge = np.searchsorted(text, np.arange(len(texts) + 1))
        collapsed = []
        for t, a, b in zip(texts, edge, edge[1:]):
            if a < b:
                keep = np.ones(len(t), bool)
                for at, n, q in zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist()):
                    keep[at + q:at + n] = False
                t = [w for w, k in zip(t, keep.tolist()) if k]
            collapsed.append(b" ".join(t))
        runs = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"]))
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("key"), pa.array(sizes), runs, pa.array(collapsed, pa.binary())],
                                          names=["doc_id", "key", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[list[bytes]] = []
            begin = held = 0
            for i, x in enumerate(batch.column("text")):
                texts.append((x.as_py() or b"").split())  # of bytes: at space and the control characters 9 to 13
                held += len(texts[-1])
                if held >= room or i + 1 == batch.num_rows:
                    yield work(batch.slice(begin, i + 1 - begin), texts)
                    texts, begin, held = [], i + 1, 0
    return run


def periodic_runs(docs: DataFrame, least: int = 6, periods: int = 4, room: int = WORDS) -> DataFrame:
    """``doc_id, key, n_words, runs, collapsed`` of every row of ``docs``.

    ``runs``: ``start, length, period`` in words, by start, then period, of all stretches of at least ``least`` words and ``periods`` periods that cannot be made
    longer; ``collapsed``: the text's words, joined by a space, without those that some run holds after its first period; ``key``: the text's digest.

    Words are what stands between spaces and the control characters 9 to 13, as they are. Null and empty texts, and texts of blanks, have no runs and
    an empty ``collapsed``. Repeated rows and rows with null ids are rows like others. An empty table gives an empty result. Only ids and texts are read.
    There is no shuffle; a text is held whole by one task, and a task holds about ``room`` words, or one text, at a time.
    """
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key STRING, n_words BIGINT, "
              "runs ARRAY<STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>>, collapsed BINARY")
    return rows.mapInArrow(_finder(least, periods, room), schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def looped(docs: DataFrame) -> DataFrame:
    """The rows, of which a tenth, by the CRC32 of the decimal id, end in words that repeat: known runs in real texts.

    With ``h`` the checksum and ``g = floor(h / 10)``, a text of ``n > 0`` words with ``h % 10 = 0`` keeps its first ``a = g % n`` words, and from there repeats the next
    ``1 + floor((n - a) / (3 + g % 8))``. Other texts, and those of null ids, stay as they are.
    """
    h, g, a, p, words = fresh(docs, "crc", "crc_rest", "loop_at", "loop_of", "loop_words")
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    out = docs.withColumn(h, checksum).withColumn(g, F.floor(F.col(h) / 10).cast("long"))
    chosen = (F.col(h) % 10 == 0) & F.col("text").isNotNull()
    out = out.withColumn(words, F.when(chosen, F.filter(F.split("text", BLANK), lambda w: w != "")))
    n = F.size(words).cast("long")
    out = out.withColumn(a, F.when(n > 0, F.col(g) % n)).withColumn(p, 1 + F.floor((n - F.col(a)) / (3 + F.col(g) % 8)))

    def word(i: Column) -> Column:
        at = F.when(i >= F.col(a), F.col(a) + (i - F.col(a)) % F.col(p)).otherwise(i)
        return F.get(F.col(words), at.cast("int"))
    rewritten = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
    return out.withColumn("text", F.when(F.col(a).isNotNull(), rewritten).otherwise(F.col("text"))).drop(h, g, a, p, words)


def run_digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256``: the run of most periods (then least start, then least
    period), nulls without any, and digests of all runs and of the collapsed text."""
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.reduce(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda acc, x: F.when(more(x, acc), x).otherwise(acc))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


by_value(__name__)
