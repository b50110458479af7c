"""Character n-grams of many texts at once, for tasks that get prepared texts in Arrow batches.

A gram is the number its characters make to the base of the alphabet, so that counting grams is sorting numbers; only distinct grams become strings. Texts
are looked at together up to ``CHUNK`` code points, a longer text in overlapping parts of that size, so arrays do not grow with a batch or a text.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

CHUNK = 1 << 20
LIMIT = 1 << 62
SMALL = 1 << 22  # entries of a table
ROWS = 1 << 18  # rows of a batch that is made


def parts(texts: list[str | None], hi: int) -> Iterator[tuple[int, list[str], int]]:
    """``(number of the first text, texts, size)``: texts of about ``CHUNK`` code points together, or a part of a long one; grams that start behind ``size`` belong to the next part."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > CHUNK:
            yield first, held, size
            first, held, size = i, [], 0
        if len(text) > CHUNK:
            for a in range(0, len(text), CHUNK):
                yield i, [text[a:a + CHUNK + hi - 1]], CHUNK
            first = i + 1
        else:
            held.append(text)
            size += len(text)
    if held:
        yield first, held, size


def _laid_out(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, and for each the number of its text and how many code points that has from there on; none behind ``size``."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    lengths = np.array([len(t) for t in texts], np.int64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
    left[size:] = 0
    return points, np.repeat(np.arange(len(texts)), lengths), left


def _runs(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def _pairs_of(texts: list[str], size: int, lo: int, hi: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """For each size of gram: the grams, and for pairs of gram and text in order of the gram where each gram's begin, the texts and the occurrences."""
    points, text_of, left = _laid_out(texts, size)
    there = np.zeros(0x110000, bool)
    there[points] = True
    alphabet = np.flatnonzero(there).astype("<u4")
    rank = np.zeros(0x110000, np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    ranks, base, bound, plain = rank[points], max(len(alphabet), 1), 1, True
    key = np.zeros(len(points), np.int64)
    for n in range(1, hi + 1):
        m = len(points) - n + 1
        if m <= 0:
            return
        if bound * base * len(texts) >= LIMIT:  # numbers of the prefixes that there are, in place of their digits
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            bound, plain = len(key) + 1, False
        key = key[:m] * base + ranks[n - 1:]
        bound *= base
        if n < lo:
            continue
        at = np.flatnonzero(left[:m] >= n)
        pairs = key[at] * len(texts) + text_of[at]
        pairs.sort()
        starts = _runs(pairs)
        of_text = np.diff(starts, append=len(pairs))
        keys = pairs[starts] // len(texts)
        first = _runs(keys)
        if not len(first):
            continue
        if plain:
            digits, rest = np.empty((len(first), n), "<u4"), keys[first]
            for j in range(n - 1, -1, -1):
                rest, digit = np.divmod(rest, base)
                digits[:, j] = alphabet[digit]
            letters = digits.tobytes().decode("utf-32-le")
            grams = [letters[i:i + n] for i in range(0, len(letters), n)]
        else:
            found, place = np.unique(key[at], return_index=True)  # as sorted as ``keys``
            joined = "".join(texts)
            grams = [joined[i:i + n] for i in at[place].tolist()]
        yield grams, first, pairs[starts] - keys * len(texts), of_text


def _count_part(texts: list[str], size: int, lo: int, hi: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """For each size of gram: the grams, their occurrences and the texts that hold them."""
    for grams, first, _, of_text in _pairs_of(texts, size, lo, hi):
        yield grams, np.add.reduceat(of_text, first), np.diff(first, append=len(of_text))


def count_in_texts(batches: Iterator[pa.RecordBatch], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(..., gram, tf)`` of prepared texts, the last column, with the columns before it: the grams of every text. A text has ``CHUNK`` code points at most."""
    for batch in batches:
        keep = [batch.column(i) for i in range(batch.num_columns - 1)]
        names = [*batch.schema.names[:-1], "gram", "tf"]
        for start, texts, size in parts(batch.column(batch.num_columns - 1).to_pylist(), hi):
            for grams, first, text, of_text in _pairs_of(texts, size, lo, hi):
                gram = np.repeat(np.arange(len(first)), np.diff(first, append=len(text)))
                for a in range(0, len(text), ROWS):
                    at = pa.array(text[a:a + ROWS] + start)
                    rows = [*(c.take(at) for c in keep), pa.array(grams, pa.string()).take(pa.array(gram[a:a + ROWS])), pa.array(of_text[a:a + ROWS], pa.int64())]
                    yield pa.record_batch(rows, names)


def count_grams(batches: Iterator[pa.RecordBatch], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(gram, n, df)`` of prepared texts, the first column: occurrences of a gram and texts that hold it. Each part of a batch has a row for each of its grams."""
    def row(grams: list[str], n, df) -> pa.RecordBatch:
        return pa.record_batch([pa.array(grams, pa.string()), pa.array(n, pa.int64()), pa.array(df, pa.int64())], ["gram", "n", "df"])

    for batch in batches:
        whole, number = Counter(), -1  # of the long text that is being counted
        for first, texts, size in parts(batch.column(0).to_pylist(), hi):
            is_long = len(texts[0]) > CHUNK or first == number
            if whole and first != number:
                yield row(list(whole), list(whole.values()), [1] * len(whole))
                whole = Counter()
            number = first if is_long else -1
            for grams, n, df in _count_part(texts, size, lo, hi):
                if is_long:
                    for gram, k in zip(grams, n.tolist()):
                        whole[gram] += k
                else:
                    yield row(grams, n, df)
        if whole:
            yield row(list(whole), list(whole.values()), [1] * len(whole))


def _numbered(key: np.ndarray, bound: int) -> tuple[np.ndarray, int]:
    """Keys below ``bound`` as numbers of those that there are, and how many these are."""
    if bound > 4 * SMALL:
        known, number = np.unique(key, return_inverse=True)
        return number.astype(np.int64), len(known)
    there = np.zeros(bound, bool)
    there[key] = True
    return (np.cumsum(there) - 1)[key], int(there.sum())


def summed(counts: Iterator[pa.RecordBatch], rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows ``(gram, n)`` added up by gram, so many of them together."""
    def added(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        out = pa.Table.from_batches(held).group_by("gram", use_threads=False).aggregate([("n", "sum")])
        return out.select(["gram", "n_sum"]).rename_columns(["gram", "n"]).combine_chunks().to_batches()

    held, waiting = [], 0
    for batch in counts:
        held.append(batch)
        waiting += batch.num_rows
        if waiting >= rows:
            yield from added(held)
            held, waiting = [], 0
    if held:
        yield from added(held)


def count_occurrences(batches: Iterator[pa.RecordBatch], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(gram, n)`` of prepared texts, the first column: occurrences of a gram. Without the texts that hold it a table counts, and nothing is sorted where the grams are few enough for one."""
    for batch in batches:
        for _, texts, size in parts(batch.column(0).to_pylist(), hi):
            points, _, left = _laid_out(texts, size)
            there = np.zeros(0x110000, bool)
            there[points] = True
            ranks, base = (np.cumsum(there) - 1)[points], max(int(there.sum()), 1)
            key, bound = np.zeros(len(points), np.int64), 1
            for n in range(1, min(hi, len(points)) + 1):
                m = len(points) - n + 1
                if bound * base > SMALL:
                    key, bound = _numbered(key, bound)
                key, bound = key[:m] * base + ranks[n - 1:], bound * base
                at = np.flatnonzero(left[:m] >= n)
                if n < lo or not len(at):
                    continue
                if bound <= 4 * SMALL:
                    counts = np.bincount(key[at], minlength=bound)
                    place = np.empty(bound, np.int64)
                    place[key[at]] = at  # of each gram some place where it stands
                    found = np.flatnonzero(counts)
                    counts, place = counts[found], place[found]
                else:
                    _, first, counts = np.unique(key[at], return_index=True, return_counts=True)
                    place = at[first]
                letters = points[place[:, None] + np.arange(n)].tobytes().decode("utf-32-le")
                yield pa.record_batch([pa.array([letters[i:i + n] for i in range(0, len(letters), n)], pa.string()), pa.array(counts, pa.int64())], ["gram", "n"])


class _Places:
    """Places of numbers in a sorted array, -1 for those that are not there; by a table where ``bound`` is small."""

    def __init__(self, known: np.ndarray, bound: int):
        self.known, self.table = known, None
        if bound <= SMALL:
            self.table = np.full(bound, -1, np.int32)
            self.table[known] = np.arange(len(known))

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[numbers].astype(np.int64)
        at = np.minimum(np.searchsorted(self.known, numbers), len(self.known) - 1)
        return np.where(self.known[at] == numbers, at, -1)


class Weights:
    """The TF-IDF of prepared texts over a list of grams of ``lo`` to ``hi`` characters, ``scale`` being the second factor of each. Tables are made where it is used."""

    def __init__(self, grams: list[str], scale: np.ndarray, lo: int, hi: int, sublinear: bool):
        self.grams, self.scale, self.lo, self.hi, self.sublinear = grams, np.asarray(scale, float), lo, hi, sublinear

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("grams", "scale", "lo", "hi", "sublinear")}

    @cached_property
    def _alphabet(self) -> tuple[np.ndarray, int]:
        """Rank of every code point, 0 for those of no gram; and the base."""
        rank, letters = np.zeros(0x110000, np.int64), sorted({ord(c) for gram in self.grams for c in gram})
        rank[letters] = np.arange(1, len(letters) + 1)
        return rank, len(letters) + 1

    @cached_property
    def _columns(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By size: the places of the grams of this size, and their ranks."""
        rank, out = self._alphabet[0], {}
        for n in range(self.lo, self.hi + 1):
            places = np.array([i for i, g in enumerate(self.grams) if len(g) == n], np.int64)
            points = np.frombuffer("".join(self.grams[i] for i in places).encode("utf-32-le"), "<u4")
            out[n] = places, rank[points].reshape(len(places), n)
        return out

    def _keys(self, letter, n: int) -> tuple[np.ndarray, int]:
        """Numbers of grams of ``n`` characters, ``letter(j)`` being the ranks of their j-th ones; and what they are less than."""
        base = self._alphabet[1]
        key, bound = letter(0), base
        for j in range(1, n):
            if bound * base > SMALL:  # the number of the prefix among those of the grams; 0 for others
                prefixes = self._prefixes(j)
                key, bound = prefixes(key) + 1, len(prefixes.known) + 1
            key = key * base + letter(j)
            bound *= base
        return key, bound

    def _prefixes(self, j: int) -> _Places:
        made = self.__dict__.setdefault("_made", {})
        if j not in made:
            keys = [self._keys(lambda k, r=ranks: r[:, k], j) for n, (_, ranks) in self._columns.items() if n > j]
            made[j] = _Places(np.unique(np.concatenate([k for k, _ in keys])), keys[0][1])
        return made[j]

    @cached_property
    def _sorted(self) -> dict[int, tuple[_Places, np.ndarray]]:
        out = {}
        for n, (places, ranks) in self._columns.items():
            if len(places):
                keys, bound = self._keys(lambda k, r=ranks: r[:, k], n)
                order = np.argsort(keys)
                out[n] = _Places(keys[order], bound), places[order]
        return out

    def _codes(self, first: int, texts: list[str], size: int) -> np.ndarray:
        """``text * grams + gram`` for each occurrence of a known gram, sorted."""
        points, text_of, left = _laid_out(texts, size)
        ranks, codes = self._alphabet[0][points], [np.zeros(0, np.int64)]
        for n, (known, places) in self._sorted.items():
            m = len(points) - n + 1
            if m > 0:
                index = known(self._keys(lambda j: ranks[j:m + j], n)[0])
                hit = np.flatnonzero((index >= 0) & (left[:m] >= n))
                codes.append((text_of[hit] + first) * len(self.grams) + places[index[hit]])
        codes = np.concatenate(codes)
        codes.sort()
        return codes

    def entries(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(text, gram, weight)`` in order of text and gram, each text's weights of unit length and all in one piece."""
        def weighted(codes: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            text, gram = np.divmod(codes, max(len(self.grams), 1))
            weight = (1.0 + np.log(tf) if self.sublinear else tf.astype(float)) * self.scale[gram]
            starts = _runs(text)
            norm = np.sqrt(np.add.reduceat(weight * weight, starts)) if len(starts) else weight
            return text, gram, weight / np.repeat(norm, np.diff(starts, append=len(text)))

        codes, tf, number = [], [], -1  # of the long text that is being counted
        for first, some, size in parts(texts, self.hi):
            found = self._codes(first, some, size)
            starts = _runs(found)
            counts = np.diff(starts, append=len(found))
            if first != number and codes:
                yield weighted(*_merged(codes, tf))
                codes, tf = [], []
            if len(some[0]) > CHUNK or first == number:
                number = first
                codes.append(found[starts])
                tf.append(counts)
            else:
                yield weighted(found[starts], counts)
        if codes:
            yield weighted(*_merged(codes, tf))

    def vectors(self, texts: list[str | None]) -> pa.StructArray:
        """The texts' vectors as MLlib's struct of a sparse vector."""
        found = list(self.entries(texts)) or [(np.zeros(0, np.int64),) * 3]
        text, gram, weight = (np.concatenate(x) for x in zip(*found))
        offsets = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
        return pa.StructArray.from_arrays([
            pa.array(np.zeros(len(texts)), pa.int8()), pa.array(np.full(len(texts), len(self.grams)), pa.int32()),
            pa.ListArray.from_arrays(offsets, pa.array(gram, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(weight, pa.float64())),
        ], ["type", "size", "indices", "values"])

    def products(self, texts: list[str | None], coefficients: np.ndarray) -> np.ndarray:
        """Each text's vector times the coefficients."""
        out = np.zeros(len(texts))
        for text, gram, weight in self.entries(texts):
            out += np.bincount(text, weight * coefficients[gram], len(texts))
        return out


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, place = np.unique(np.concatenate(codes), return_inverse=True)
    return every, np.bincount(place, np.concatenate(counts), len(every)).astype(np.int64)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
