"""Ranked lexical search by presence masks.

For a query, every document is one of few kinds: which of the query's terms it holds. In a block of documents the lists of places where a term
occurs are joined to such masks by bit operations, a word of 63 terms at a time. A mask's documents have a greatest possible score, from its terms' weights
and the greatest factors these terms reach in the block. Masks are evaluated in descending order of it, until the score of rank ``k`` is above all that are
left. Blocks give their best rows, of which the best are ranked.

A document's terms are looked up in the terms of a set of queries, so only what some query asks for leaves the first pass. Queries are taken in sets whose terms
are bounded; each set is a search of its own over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.base import by_value, stored

#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII; of these only A-Z are lower-cased.
SEPARATORS = bytes(b for b in range(0x80) if not chr(b).isalnum())
TO_TERMS = bytes.maketrans(SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(SEPARATORS) + bytes(range(0x61, 0x7B)))
SET = 1 << 22  # characters of a set of queries, which every task holds
BLOCK = 1 << 16  # documents of a block
POSTINGS = 1 << 21  # places of a block, at which it is closed before it has all its documents
WORD = 63


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(TO_TERMS).split()  # by now blanks are the only separators


def _lookup(number: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at, term, times = [], [0], [], []
            for x in batch.column("text"):
                terms = terms_of(x.as_py() or b"")
                n.append(len(terms))
                found = Counter(filter(number.__contains__, terms))
                term += [number[t] for t in found]
                times += found.values()
                at.append(len(term))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, t)) for v, t in ((term, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])
    return run


class Block:
    """Documents by terms: for every term the places it occurs in, ascending, and its factors there."""

    def __init__(self, sizes: np.ndarray, lengths: np.ndarray, terms: np.ndarray, times: np.ndarray, documents: int, words: int):
        self.docs = len(sizes)
        doc = np.repeat(np.arange(self.docs), sizes)
        # whole numbers of any size: lengths times documents may pass 64 bits
        damping = np.array([75 + 25 * n * documents // max(words, 1) for n in lengths.tolist()], np.int64)
        factor = (1_000_000_000 * times) // (1_000 * times + 12 * damping[doc])
        order = np.argsort(terms, kind="stable")
        self.doc, self.factor, terms = doc[order], factor[order], terms[order]
        first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, int)
        self.span = dict(zip(terms[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(terms)])))
        self.most = dict(zip(terms[first].tolist(), np.maximum.reduceat(self.factor, first).tolist())) if len(first) else {}

    def best(self, query: list[tuple[int, int]], k: int, wave: int = 4_096) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all that may be among the ``k`` best for a query of ``(term, weight)``: those at or above the ``k``-th score."""
        present = [(t, w) for t, w in query if t in self.span and w > 0]
        if not present:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        masks = np.zeros((-(-len(present) // WORD), self.docs), np.int64)
        for i, (t, _) in enumerate(present):
            a, b = self.span[t]
            masks[i // WORD, self.doc[a:b]] |= 1 << i % WORD
        place = np.flatnonzero(masks.any(axis=0))
        # documents by mask, and of every mask the greatest score its terms allow
        kinds, kind = np.unique(masks[:, place], axis=1, return_inverse=True) if len(masks) > 1 else np.unique(masks[0, place], return_inverse=True)
        kinds, kind = kinds.reshape(len(masks), -1), kind.ravel()
        bound = np.zeros(kinds.shape[1], np.int64)
        for i, (t, w) in enumerate(present):
            bound += (kinds[i // WORD] >> i % WORD & 1) * (w * self.most[t])
        descending = np.argsort(-bound, kind="stable")
        members = np.argsort(kind, kind="stable")
        size = np.bincount(kind, minlength=len(bound))
        start = np.cumsum(size) - size
        done, scores = [], []
        at, kth = 0, 0
        while at < len(descending) and bound[descending[at]] >= max(kth, 1):
            # whole masks, as many as make a wave, none of them below the score to beat
            group = descending[at:at + wave]
            group = group[:max(1, int(np.searchsorted(np.cumsum(size[group]), wave, "right")))]
            group = group[bound[group] >= max(kth, 1)]
            at += len(group)
            docs = np.sort(place[members[np.repeat(start[group] - np.cumsum(size[group]) + size[group], size[group]) + np.arange(size[group].sum())]])
            score = np.zeros(len(docs), np.int64)
            for t, w in present:
                a, b = self.span[t]
                found = np.minimum(np.searchsorted(self.doc[a:b], docs), b - a - 1)
                score += np.where(self.doc[a:b][found] == docs, w * self.factor[a:b][found], 0)
            done.append(docs)
            scores.append(score)
            every = np.concatenate(scores)
            if len(every) >= k:
                kth = int(np.partition(every, len(every) - k)[len(every) - k])
        docs, score = np.concatenate(done), np.concatenate(scores)
        keep = (score >= kth) & (score > 0)
        return docs[keep], score[keep]


def _searcher(queries: list[list[tuple[int, int]]], k: int, documents: int, words: int, block: int, postings: int):
    def search(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, n, terms, times = (rows.column(c).combine_chunks() for c in ("doc_id", "n", "terms", "times"))
        found = Block(terms.value_lengths().to_numpy(), n.to_numpy(), terms.flatten().to_numpy(), times.flatten().to_numpy(), documents, words)
        order = np.empty(len(ids), np.int64)  # of equal scores the least id comes first, nulls last
        order[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        which, place, scores = [], [], []
        for number, query in enumerate(queries):
            docs, score = found.best(query, k)
            best = np.lexsort((order[docs], -score))[:k]
            which.append(np.full(len(best), number))
            place.append(docs[best])
            scores.append(score[best])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(which)), ids.take(pa.array(np.concatenate(place))), pa.array(np.concatenate(scores))],
                                          names=["query", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, places = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                held.append(batch.slice(at, block))
                docs += held[-1].num_rows
                places += len(held[-1].column("terms").flatten())
                if docs >= block or places >= postings:
                    yield search(held)
                    held, docs, places = [], 0, 0
        if held:
            yield search(held)
    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, set_chars: int = SET, block: int = BLOCK, postings: int = POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of greatest score above 0 for every row of ``items`` (``item_id, text``).

    With ``N`` documents of at least one term, ``L`` terms of all documents, ``n`` of one, ``df`` documents with a term, and ``tf`` places of it in a document, a
    term counts ``floor(1000 ln((2 N + 2) / (2 df + 1))) * (10**9 tf div (1000 tf + 12 m))`` with ``m = 75 + 25 n N div L``, once for each place in
    the item's text. Equal scores go by ``doc_id``, nulls last.

    Null and empty texts have no terms: such items have no rows, such documents are in none. Every row of ``docs`` is a document, rows with a null or repeated id
    too. Items repeated with id and text are one; items that share an id are ranked each for itself. Without items or documents the result is empty. Other columns are not
    looked at. ``set_chars`` bounds what the driver and every task hold of the items; more items are more passes over the documents.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    types = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    asked = items.select("item_id", "text").filter("text IS NOT NULL").distinct()
    sets = -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // set_chars)
    out = spark.createDataFrame([], f"item_id {types[0]}, rank INT, doc_id {types[1]}, score BIGINT")
    for i in range(sets):
        # a share of the items by their hash: about set_chars, whatever their number
        held = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(sets)) == i).collect()
        wanted = [Counter(terms_of(r.text.encode())) for r in held]
        number = {t: j for j, t in enumerate(sorted(set().union(*wanted)))}
        if not number:
            continue
        found = stored(rows.mapInArrow(_lookup(number), f"doc_id {types[1]}, n BIGINT, terms ARRAY<INT>, times ARRAY<BIGINT>"), "mask-terms")
        documents, words = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r.term: r.n for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
        weight = {j: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for j, n in df.items()}
        queries = [[(number[t], c * weight[number[t]]) for t, c in w.items() if number[t] in weight] for w in wanted]
        best = found.mapInArrow(_searcher(queries, k, documents, words, block, postings), f"query BIGINT, doc_id {types[1]}, score BIGINT")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = best.withColumn("rank", place).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(j, r.item_id) for j, r in enumerate(held)], f"query BIGINT, item_id {types[0]}")
        out = out.unionByName(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out


by_value(__name__)
