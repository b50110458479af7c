"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

A first pass gives every task's distinct n-grams with their counts in its trusted text; they are summed per n-gram. All
model quantities (continuation counts, discounts, context totals) are aggregates of those sums, joined by n-gram or context, so
the model is sharded like any table and has no size limit. For scoring, every task packs its documents by language into compressed packets, and packets of a
language are dealt into blocks of bounded size. A block asks for its distinct n-grams' probabilities once, not once per document, and gets them by a join with
the sharded table; then each document's log probability is summed. Models are kept per language, and three at once: of all trusted text, and of each half of it.
Trusted documents are judged by the half that they are not in, so that the threshold, a quantile per language, holds for
documents the model has not seen.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.base import by_value, columns, fresh, same, stored, text_key

PAD = 0xFFFF  # stands before a text; no character
CHUNK = 1 << 21
MODELS = (0, 1, 2)  # all trusted text, its first half, its second half
PACKET = 1 << 20  # bytes of text in a packet
LANGUAGES = 10_000  # rows of a table of languages up to which it is broadcast; it is joined like any other beyond


def _codes(text: bytes) -> np.ndarray:
    """Code points as the model sees them: digits are one symbol, and NUL, which array strings drop, has a stand-in."""
    codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4").copy()
    codes[(codes >= 0x30) & (codes <= 0x39)] = 0x30
    codes[codes == 0] = 0x2400
    return codes


def _runs(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in runs of about ``CHUNK`` code points: codes with what stands before each part, positions of n-gram starts, and the text
    each belongs to. A long text goes over several runs."""
    parts, owner, size = [], [], 0
    pad = np.full(order - 1, PAD, "<u4")
    for i, text in enumerate(texts):
        codes = np.concatenate([pad, _codes(text)])
        for a in range(0, len(codes) - order + 1, CHUNK):
            part = codes[a:a + CHUNK + order - 1]
            parts.append(part)
            owner.append(i)
            size += len(part)
            if size >= CHUNK:
                yield _run(parts, owner, order)
                parts, owner, size = [], [], 0
    if parts:
        yield _run(parts, owner, order)


def _run(parts: list[np.ndarray], owner: list[int], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in parts])
    grams = lengths - order + 1
    starts = np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(grams) - grams), grams) + np.arange(grams.sum())
    return np.concatenate(parts), starts, np.repeat(owner, grams)


class Packer:
    """n-grams of a bounded set of symbols as integers below ``LIMIT``.

    With more symbols than that allows, the distinct halves of the n-grams are numbered first (``see_halves``), and an n-gram is a pair of
    numbers of halves.
    """

    LIMIT = (1 << 63) // 3  # a key is counted together with one of three folds

    def __init__(self, order: int):
        self.order, self.used = order, np.zeros(0x110000, bool)
        self.halves: list[np.ndarray] | None = None

    def see(self, codes: np.ndarray) -> None:
        self.used[codes] = True

    def close(self) -> None:
        self.symbols = np.flatnonzero(self.used)
        self.number = np.zeros(0x110000, np.int64)
        self.number[self.symbols] = np.arange(len(self.symbols))
        self.base = max(2, len(self.symbols))

    @property
    def wide(self) -> bool:
        return self.base ** self.order > self.LIMIT

    def _word(self, codes: np.ndarray, starts: np.ndarray, first: int, end: int) -> np.ndarray:
        numbers = self.number[codes]
        key = numbers[starts + first]
        for k in range(first + 1, end):
            key = key * self.base + numbers[starts + k]
        return key

    def _parts(self) -> list[tuple[int, int]]:
        half = self.order // 2
        return [(0, half), (half, self.order)]

    def see_halves(self, runs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Numbers the halves of all n-grams of the runs."""
        if self.base ** (self.order - self.order // 2) >= 1 << 63:
            raise ValueError("half an n-gram of this order does not fit in an integer")
        self.halves = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for codes, starts, _ in runs:
            self.halves = [np.union1d(h, self._word(codes, starts, *part)) for h, part in zip(self.halves, self._parts())]
        if len(self.halves[0]) * len(self.halves[1]) > self.LIMIT:
            raise ValueError("a block has more n-grams than integers; take smaller blocks")

    def pack(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.halves is None:
            return self._word(codes, starts, 0, self.order)
        head, tail = (np.searchsorted(h, self._word(codes, starts, *part)) for h, part in zip(self.halves, self._parts()))
        return head * len(self.halves[1]) + tail

    def unpack(self, keys: np.ndarray) -> list[str]:
        out = np.empty((len(keys), self.order), "<u4")
        words = [keys] if self.halves is None else [h[i] for h, i in zip(self.halves, np.divmod(keys, len(self.halves[1])))]
        for word, (first, end) in zip(words, [(0, self.order)] if self.halves is None else self._parts()):
            for k in range(end - 1, first - 1, -1):
                word, digit = np.divmod(word, self.base)
                out[:, k] = self.symbols[digit]
        return out.view(f"<U{self.order}").ravel().tolist()

    def pack_texts(self, grams: list[str]) -> np.ndarray:
        codes = np.array(grams, f"<U{self.order}").view("<u4")
        return self.pack(codes, np.arange(len(grams)) * self.order)


def _languages(docs: pa.Table | pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    langs = docs.column("lang").to_pylist()
    by: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by.setdefault(lang, []).append(i)
    for lang, rows in by.items():
        yield lang, np.array(rows)


def _packer(texts: list[bytes], order: int) -> Packer:
    packer = Packer(order)
    packer.see(np.array([PAD]))
    for text in texts:
        packer.see(_codes(text))
    packer.close()
    if packer.wide:
        packer.see_halves(_runs(texts, order))
    return packer


def _distinct(texts: list[bytes], fold: np.ndarray, order: int) -> tuple[list[str], np.ndarray]:
    """Distinct n-grams of texts, and how often each is in texts of every fold."""
    packer = _packer(texts, order)
    keys, counts = [], []
    for codes, starts, owner in _runs(texts, order):
        k, c = np.unique(packer.pack(codes, starts) * 3 + fold[owner], return_counts=True)
        keys.append(k)
        counts.append(c)
    if not keys:
        return [], np.zeros((0, 3), np.int64)
    both, place = np.unique(np.concatenate(keys), return_inverse=True)
    grams, at = np.unique(both // 3, return_inverse=True)
    out = np.zeros((len(grams), 3), np.int64)
    out[at, both % 3] = np.bincount(place, np.concatenate(counts), len(both))
    return packer.unpack(grams), out


def _counter(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct n-grams of a batch with their counts in the two halves of its trusted text; zero where it is not trusted."""
        for batch in batches:
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for lang, rows in _languages(batch):
                grams, counts = _distinct([batch.column("text")[int(i)].as_py() or b"" for i in rows], fold[rows], order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(counts[:, 1]), pa.array(counts[:, 2])],
                    names=["lang", "gram", "c1", "c2"])
    return run


def _packed(tables: list[pa.Table]) -> bytes:
    out = pa.BufferOutputStream()
    table = pa.concat_tables(tables).combine_chunks()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(packets: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in packets.column("packet")])


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and texts of a task by language, in packets of about ``PACKET`` bytes; their numbers are the task's, and the same if it runs again."""
    held: dict[str, list[pa.Table]] = {}
    size: dict[str, int] = {}
    task, made = TaskContext.get().partitionId(), 0

    def packet(lang: str) -> pa.RecordBatch:
        nonlocal made
        made += 1
        size.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([task << 32 | made]), pa.array([_packed(held.pop(lang))], pa.binary())],
                                          names=["lang", "number", "packet"])
    for batch in batches:
        table = pa.Table.from_batches([batch]).select(["doc_id", "text"])
        for lang, rows in _languages(batch):
            for at in range(0, len(rows), 256):
                part = table.take(pa.array(rows[at:at + 256]))
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + part.nbytes
                if size[lang] >= PACKET:
                    yield packet(lang)
        while sum(size.values()) >= 32 * PACKET:  # many languages
            yield packet(max(size, key=size.get))
    for lang in list(held):
        yield packet(lang)


def _ask(order: int):
    def run(key: tuple, packets: pa.Table) -> pa.Table:
        """Distinct n-grams of a block."""
        texts = [x.as_py() or b"" for x in _unpacked(packets).column("text")]
        grams, _ = _distinct(texts, np.zeros(len(texts), np.int64), order)
        lang, block = (k.as_py() for k in key)
        return pa.table({"lang": pa.array([lang] * len(grams), pa.string()), "block": pa.array([block] * len(grams), pa.int64()), "gram": pa.array(grams, pa.string())})
    return run


def _score(order: int):
    def run(key: tuple, packets: pa.Table, scores: pa.Table) -> pa.Table:
        """Code points and negative log probabilities of every document of a block."""
        docs = _unpacked(packets)
        texts = [x.as_py() for x in docs.column("text")]
        filled = [x or b"" for x in texts]
        count, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(MODELS)))
        packer = _packer(filled, order)
        if scores.num_rows:
            known = packer.pack_texts(scores.column("gram").to_pylist())
            rank = np.argsort(known)
            known, values = known[rank], np.stack([scores.column(f"p{m}").to_numpy() for m in MODELS], 1)[rank]
            for codes, starts, owner in _runs(filled, order):
                found = np.searchsorted(known, packer.pack(codes, starts))
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                np.add.at(sums, owner[first], np.add.reduceat(values[found], first, axis=0, dtype=float))
                np.add.at(count, owner[first], np.diff(first, append=len(owner)))
        keys = [None if x is None else hashlib.md5(x).hexdigest() for x in texts]
        return pa.table({"doc_id": docs.column("doc_id"), "key": pa.array(keys, pa.string()), "lang": pa.array([key[0].as_py()] * len(texts), pa.string()), "n": count,
                         **{f"s{m}": -sums[:, m] for m in MODELS}})
    return run


def _languages_table(df: DataFrame, purpose: str) -> DataFrame:
    """A table of one row a language, written and counted, and broadcast if it has at most ``LANGUAGES``."""
    df = stored(df, purpose)
    return F.broadcast(df) if df.count() <= LANGUAGES else df


def _discounts(counts: DataFrame, models: tuple[int, ...]) -> DataFrame:
    """``lang, k`` and for each model the symbols seen and one more, ``symbols<model>``, which order one needs, and the modified Kneser-Ney
    discounts of the order ``k``: for counts of one, two, and three or more."""
    n = [F.count_if(F.col(f"c{m}") == i).alias(f"n{m}{i}") for m in models for i in (1, 2, 3, 4)]
    sums = counts.groupBy("lang", "k").agg(*n, *[(F.count_if(F.col(f"c{m}") > 0) + 1).alias(f"symbols{m}") for m in models])

    def discount(m: int, i: int) -> Column:
        y = F.col(f"n{m}1") / (F.col(f"n{m}1") + 2 * F.col(f"n{m}2"))
        # without any n-gram of some count the formula has no value, and half the count is taken off
        value = F.coalesce(F.when(F.col(f"n{m}{i}") > 0, i - (i + 1) * y * F.col(f"n{m}{i + 1}") / F.col(f"n{m}{i}")), F.lit(0.5 * i))
        return F.greatest(F.least(value, F.lit(0.99 * i)), F.lit(0.01)).alias(f"d{m}{i}")
    return sums.select("lang", "k", *[f"symbols{m}" for m in models], *[discount(m, i) for m in models for i in (1, 2, 3)])


def probabilities(counts: DataFrame, order: int, models: tuple[int, ...] = (0,)) -> DataFrame:
    """``lang, gram`` and for each model the interpolated modified Kneser-Ney probability ``p<model>`` of the gram's last symbol.

    ``counts``: ``lang, gram, c<model>`` of the highest order; grams that are only asked for have counts of zero. Orders below have
    the counts of their different left extensions. A context that was never seen leaves the symbol to the next order, and below the first
    stands the uniform distribution over the symbols seen and one for all others.

    Orders are worked out from the first one up, each written and joined with the next by the gram without its first symbol. So the plan of an order is the same whatever the
    order, and the rows of the highest, which are most, are joined for it alone.
    """
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        extensions = [F.count_if(F.col(f"c{m}") > 0).alias(f"c{m}") for m in models]
        tables[k] = stored(tables[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(*extensions), "ngrams")
    every = [tables[k].select("lang", F.lit(k).alias("k"), *[f"c{m}" for m in models]) for k in tables]
    languages = stored(_discounts(functools.reduce(DataFrame.union, every), models), "ngram-discounts")
    few = languages.count() <= LANGUAGES * order
    below = None
    for k in range(1, order + 1):
        sums = [x for m in models for c in [F.col(f"c{m}")] for x in (
            F.sum(c).alias(f"total{m}"), F.count_if(c == 1).alias(f"one{m}"), F.count_if(c == 2).alias(f"two{m}"), F.count_if(c > 2).alias(f"more{m}"))]
        context = tables[k].groupBy("lang", F.substring("gram", 1, k - 1).alias("h")).agg(*sums)
        own = languages.filter(F.col("k") == k).drop("k")
        out = tables[k].withColumn("h", F.substring("gram", 1, k - 1)).join(context, ["lang", "h"]).join(F.broadcast(own) if few else own, "lang")
        if below is None:
            out = out.select("*", *[F.when(F.col(f"symbols{m}") > 1, 1 / F.col(f"symbols{m}")).otherwise(1.0).alias(f"p{m}") for m in models])
        else:
            out = out.withColumn("g", F.substring("gram", 2, k - 1)).join(below.withColumnRenamed("gram", "g"), ["lang", "g"])

        def interpolated(m: int) -> Column:
            c, total, below = F.col(f"c{m}"), F.col(f"total{m}"), F.col(f"p{m}")
            d1, d2, d3 = (F.col(f"d{m}{i}") for i in (1, 2, 3))
            own = F.greatest(c - F.when(c == 0, 0.0).when(c == 1, d1).when(c == 2, d2).otherwise(d3), F.lit(0.0))
            rest = d1 * F.col(f"one{m}") + d2 * F.col(f"two{m}") + d3 * F.col(f"more{m}")
            return F.when(total == 0, below).otherwise((own + rest * below) / total).alias(f"p{m}")
        out = out.select("lang", "gram", *[interpolated(m) for m in models])
        below = stored(out, "ngram-probabilities") if k < order else out
    return below


def perplexities(docs: DataFrame, labels: DataFrame, order: int = 4, block_chars: int = 16_000_000, most_broadcast: int = 2_000_000) -> DataFrame:
    """``doc_id, key, lang, n, s0, s1, s2``: of every row its digest, code points, and negative log probabilities by the models.

    ``labels``: ``doc_id, fold`` of trusted documents; they are broadcast where there are at most ``most_broadcast``, and joined by a shuffle
    otherwise. Blocks are of one language each, of packets of neighbouring rows, so that a row repeated very often is in many of them.
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.col("text").cast("binary").alias("text"))
    marks = labels.select(F.col("doc_id").alias("mark"), (F.col("fold") + 1).alias("fold"))
    if labels.count() <= most_broadcast:
        marks = F.broadcast(marks)
    marked = rows.join(marks, F.col("doc_id") == F.col("mark"), "left").select("lang", "text", F.coalesce("fold", F.lit(0)).cast("long").alias("fold"))
    sums = marked.mapInArrow(_counter(order), "lang STRING, gram STRING, c1 BIGINT, c2 BIGINT").groupBy("lang", "gram").agg(
        F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    grams = stored(sums.select("lang", "gram", (F.col("c1") + F.col("c2")).alias("c0"), "c1", "c2"), "ngrams")
    found = probabilities(grams, order, MODELS)
    wide = stored(found.select("lang", "gram", *[F.log(f"p{m}").cast("float").alias(f"p{m}") for m in MODELS]), "ngram-scores")

    chars = rows.groupBy("lang").agg(F.ceil(F.sum(F.octet_length("text")) / block_chars).alias("blocks")).filter("blocks > 1")
    packed = rows.mapInArrow(_packets, "lang STRING, number BIGINT, packet BINARY")
    packed = packed.join(_languages_table(chars, "ngram-blocks"), "lang", "left").select(
        "lang", F.pmod(F.xxhash64("number"), F.coalesce("blocks", F.lit(1))).alias("block"), "packet")
    # the packets' exchange is the same in both places and runs once
    asked = packed.groupBy("lang", "block").applyInArrow(_ask(order), "lang STRING, block BIGINT, gram STRING")
    answers = asked.join(wide, ["lang", "gram"]).select("lang", "block", "gram", *[f"p{m}" for m in MODELS])
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key STRING, lang STRING, n BIGINT, "
              + ", ".join(f"s{m} DOUBLE" for m in MODELS))
    return packed.groupBy("lang", "block").cogroup(answers.groupBy("lang", "block")).applyInArrow(_score(order), schema)


def judge(docs: DataFrame, labels: DataFrame, trusted: Column | None = None, order: int = 4, quantile: float = 0.99, prior: int = 100,
          least: int = 20, block_chars: int = 16_000_000) -> DataFrame:
    """``doc_id, key, lang, n_chars, perplexity, score, threshold, kept`` of every row of ``docs``.

    ``labels``: ``doc_id`` and whatever ``trusted`` (by default: quality 1, not toxic) looks at. ``score`` is the mean negative log probability of a
    character, with ``prior`` characters of the language's trusted mean added, so that short texts are not judged by chance. A row is kept if it is not above
    the ``quantile`` of its language's trusted scores. Rows of languages with fewer than ``least`` trusted documents, and empty or null
    texts, cannot be judged and are kept. A null language is one of its own (written as the empty string). Rows with null ids have no
    label; repeated rows are judged each; a label given twice holds if one of them is trusted. Empty tables give empty results.
    """
    trusted = trusted if trusted is not None else (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    marks = labels.filter(F.col("doc_id").isNotNull() & trusted).select("doc_id").distinct()
    marks = marks.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int"))
    rows = stored(perplexities(docs, marks, order, block_chars), "perplexity")
    mark, fold = marks.select(F.col("doc_id").alias("mark"), "fold"), F.col("fold")
    rows = rows.join(mark, F.col("doc_id") == F.col("mark"), "left")
    # a document in one half is judged by the model of the other half
    rows = rows.withColumn("s", F.when(fold == 0, F.col("s2")).when(fold == 1, F.col("s1")).otherwise(F.col("s0")))
    good = rows.filter("fold IS NOT NULL AND n > 0")
    means = _languages_table(good.groupBy("lang").agg((F.sum("s") / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("trusted")), "trusted-means")
    shrunk = (F.col("s") + prior * F.col("mean")) / (F.col("n") + prior)
    limits = good.join(means, "lang").groupBy("lang").agg(F.percentile_approx(shrunk, F.lit(quantile), F.lit(100_000)).alias("threshold"))
    limits = means.join(limits, "lang").filter(F.col("trusted") >= least).select(F.col("lang").alias("l"), "mean", "threshold")
    out = rows.join(_languages_table(limits, "thresholds"), F.col("lang") == F.col("l"), "left")
    judged = F.when(F.col("n") > 0, shrunk)
    return out.select("doc_id", "key", "lang", F.col("n").alias("n_chars"), F.when(F.col("n") > 0, F.exp(F.col("s") / F.col("n"))).alias("perplexity"),
                      judged.alias("score"), "threshold", F.coalesce(judged <= F.col("threshold"), F.lit(True)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that are kept, columns as they are. The verdict on a row holds for all rows with its id, language and text."""
    verdict = judge(docs, labels, **settings).filter("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"), F.col("lang").alias("kept_lang")).distinct()
    key, lang = fresh(docs, "text_key", "lang_key")
    keyed = docs.withColumn(key, text_key(F.col("text"))).withColumn(lang, F.coalesce("lang", F.lit("")))
    out = keyed.join(verdict, same(keyed, verdict, [("doc_id", "kept_id"), (key, "kept_key"), (lang, "kept_lang")]), "left_semi")
    return out.select(*columns(out, docs.columns))


by_value(__name__)
