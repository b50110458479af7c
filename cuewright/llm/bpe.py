"""Byte-level BPE by the ranks of a public vocabulary file.

Pre-tokens are found without a regular expression. Every code point is looked up in a class array; with the class of what follows it is
one of a few symbols, and each symbol is a function from the state "which pre-token is open" to the next. Functions of symbols
compose to few different ones (a finite monoid), and composition is associative, so the state before every
position comes from a blocked prefix scan over whole arrays. A slice is then a key of a bounded cache of merged pairs, and
its start is kept, so that ids can be decoded and traced to the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.base import by_value, fresh

LETTER, NUMBER, OTHER, BLANK = range(4)
# The code points of Unicode's White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# First and last code points of letters and of numbers that Unicode 16.0 added; Python's tables are of 15.1.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
# What may follow an apostrophe in a pre-token of its own.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
# Symbols: L N O, apostrophe with one or two letters to come, a space or another blank before a non-blank, a blank before
# a blank or the end. The same eight again at the start of a text.
SYM_A1, SYM_A2, SYM_SPACE, SYM_LAST, SYM_BLANK, START = 3, 4, 5, 6, 7, 8
# States: nothing open, letters, numbers, others, blanks, a space that waits for its word, letters of a contraction to come.
FRESH, IN_L, IN_N, IN_O, IN_BLANKS, SPACED, ONE_MORE, TWO_MORE = range(8)
CACHE_ENTRIES = 400_000
WINDOW = 1 << 20


def class_table() -> bytes:
    """The class of every code point, compressed; made once on the driver and sent with the task."""
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            table[code] = LETTER if kind == "L" else NUMBER
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in ranges:
            table[first:last + 1] = kind
    table[WHITE] = BLANK
    return zlib.compress(table.tobytes(), 9)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a pre-token starts here."""
    if symbol >= START:
        state, symbol = FRESH, symbol - START
    if state in (ONE_MORE, TWO_MORE):
        return (ONE_MORE if state == TWO_MORE else FRESH), False
    if symbol in (LETTER, NUMBER, OTHER):
        inside = symbol + IN_L
        return inside, state not in (inside, SPACED)
    if symbol in (SYM_A1, SYM_A2):
        if state in (IN_O, SPACED):
            return IN_O, False
        return (ONE_MORE if symbol == SYM_A1 else TWO_MORE), True
    if symbol == SYM_SPACE:
        return SPACED, True
    if symbol == SYM_LAST:
        return FRESH, True
    return IN_BLANKS, state != IN_BLANKS


class Boundaries:
    """Starts of pre-tokens over arrays of code points."""

    def __init__(self, classes: bytes):
        self.classes = np.frombuffer(zlib.decompress(classes), np.uint8)
        generators = [tuple(_step(s, x)[0] for s in range(8)) for x in range(16)]
        elements = [tuple(range(8)), *dict.fromkeys(generators)]
        known = {f: i for i, f in enumerate(elements)}
        for f in elements:  # grows while it is read, until closed under the generators
            for g in generators:
                h = tuple(g[s] for s in f)
                if h not in known:
                    known[h] = len(elements)
                    elements.append(h)
        k = len(elements)
        self.k = k
        self.of_symbol = np.array([known[g] for g in generators], np.intp)
        self.product = np.array([[known[tuple(g[s] for s in f)] for g in elements] for f in elements], np.intp).ravel()
        self.apply = np.array(elements, np.intp).ravel()
        self.bound = np.array([[_step(s, x)[1] for x in range(16)] for s in range(8)], bool).ravel()

    def symbols(self, codes: np.ndarray, first: np.ndarray, a: int, b: int) -> np.ndarray:
        """Symbols of positions ``a`` to ``b``; ``first`` marks the first position of every text."""
        end = min(b + 2, len(codes))
        part, start = codes[a:end], first[a:end]
        kinds = self.classes[part]
        n = b - a
        follows = np.full(n, BLANK, np.uint8)  # class of the next code point of the text; a blank at its end
        more = min(n, end - a - 1)
        follows[:more] = np.where(start[1:more + 1], BLANK, kinds[1:more + 1])
        out = kinds[:n].copy()
        blank = out == BLANK
        solid = blank & (follows != BLANK)
        out[blank] = SYM_BLANK
        out[solid] = np.where(part[:n][solid] == 0x20, SYM_SPACE, SYM_LAST)
        for i in np.flatnonzero((part[:n] == 0x27) & (follows == LETTER)):
            one = chr(part[i + 1])
            if one in ONE_LETTER:
                out[i] = SYM_A1
            elif i + 2 < len(part) and not start[i + 2] and one + chr(part[i + 2]) in TWO_LETTERS:
                out[i] = SYM_A2
        out[start[:n]] += START
        return out

    def scan(self, elements: np.ndarray) -> np.ndarray:
        """Products of all prefixes, each without its last factor."""
        n, k = len(elements), self.k
        if n <= 64:
            out = np.zeros(n, np.intp)
            for i in range(1, n):
                out[i] = self.product[out[i - 1] * k + elements[i - 1]]
            return out
        width = 64
        rows = -(-n // width)
        padded = np.zeros(rows * width, np.intp)
        padded[:n] = elements
        columns = padded.reshape(rows, width).T.copy()
        inside = np.zeros((width, rows), np.intp)
        for j in range(1, width):
            inside[j] = self.product[inside[j - 1] * k + columns[j - 1]]
        totals = self.product[inside[-1] * k + columns[-1]]
        before = self.scan(totals)
        return self.product[(before * k)[None, :] + inside].T.reshape(-1)[:n]

    def __call__(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Positions at which a pre-token starts; windows hand on the state, so memory is bounded."""
        found, state = [], FRESH
        for a in range(0, len(codes), WINDOW):
            b = min(a + WINDOW, len(codes))
            symbols = self.symbols(codes, first, a, b)
            elements = self.of_symbol[symbols]
            before = self.scan(elements)
            states = self.apply[before * 8 + state]
            found.append(np.flatnonzero(self.bound[states * 16 + symbols]) + a)
            state = int(self.apply[elements[-1] * 8 + states[-1]])
        return np.concatenate(found) if found else np.zeros(0, np.intp)


class Merger(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit integers; a cache of bounded size."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        rank = self.ranks.get(raw)
        ids = [rank] if rank is not None else (self._short if len(raw) <= 48 else self._long)(raw)
        value = np.array(ids, "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = value
        return value

    def _short(self, raw: bytes) -> list[int]:
        get = self.ranks.get
        parts = [raw[i:i + 1] for i in range(len(raw))]
        pairs = [get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
        while True:
            best, at = None, -1
            for i, rank in enumerate(pairs):
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return [self.ranks[p] for p in parts]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at])

    def _long(self, raw: bytes) -> list[int]:
        """The same merges in n log n: a heap of pairs over a linked list."""
        get, n = self.ranks.get, len(raw)
        end = list(range(1, n + 1))  # end of the part that starts here; 0 if none does
        left = list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                rank = get(raw[i:end[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or not end[j] or end[j] != k:
                continue
            end[i], end[j] = k, 0
            if k < n:
                left[k] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i:end[i]]])
            i = end[i]
        return out


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class Codec:
    """Texts to ids and back; made once in each task."""

    def __init__(self, vocabulary: bytes, classes: bytes):
        ranks = read_ranks(vocabulary)
        self.boundaries, self.merger = Boundaries(classes), Merger(ranks)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        """Of every text its ids as bytes, and where its pre-tokens start, in code points."""
        lengths = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        begins = np.cumsum(lengths) - lengths
        first = np.zeros(len(codes) + 1, bool)
        first[begins[lengths > 0]] = True
        starts = self.boundaries(codes, first[:len(codes)])
        del codes
        cuts = np.searchsorted(starts, np.append(begins, len(joined)))
        for i in range(len(texts)):
            ids = []
            for a in range(cuts[i], cuts[i + 1], 100_000):  # pieces of a long text by and by
                b = min(a + 100_000, cuts[i + 1])
                edges = starts[a:b].tolist()
                edges.append(int(starts[b]) if b < cuts[i + 1] else int(begins[i] + lengths[i]))
                pieces = [joined[x:y] for x, y in zip(edges, edges[1:])]
                ids.append(b"".join(map(self.merger.__getitem__, pieces)))
            yield b"".join(ids), starts[cuts[i]:cuts[i + 1]] - begins[i]

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4")
        get = self.tokens.__getitem__
        return b"".join(b"".join(map(get, numbers[a:a + 1_000_000].tolist())) for a in range(0, len(numbers), 1_000_000))


def _texts(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Rows of a binary column in runs of about so many characters; invalid bytes are replaced, null is empty."""
    run, size, start = [], 0, 0
    for i in range(len(column)):
        raw = column[i].as_py()
        text = raw.decode("utf-8", "replace") if raw else ""
        run.append(text)
        size += len(text)
        if size >= most:
            yield start, run
            run, size, start = [], 0, i + 1
    if run:
        yield start, run


def _encoder(vocabulary: bytes, classes: bytes, digests: bool, ids: bool, offsets: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(vocabulary, classes)
            text = batch.schema.get_field_index("__text")
            kept = [i for i in range(batch.num_columns) if i != text]
            for start, texts in _texts(batch.column(text)):
                count, tokens, sha, back, pieces = [], [], [], [], []
                for encoded, starts in codec.encode(texts):
                    count.append(len(encoded) // 4)
                    if ids:
                        tokens.append(encoded)
                    if offsets:
                        pieces.append(starts.astype(np.int32))
                    if digests:
                        sha.append(hashlib.sha256(encoded).hexdigest())
                        back.append(hashlib.sha256(codec.decode(encoded)).hexdigest())
                columns = [batch.column(i).slice(start, len(texts)) for i in kept]
                names = [batch.schema.names[i] for i in kept]
                columns.append(pa.array(count, pa.int64()))
                names.append("n_tokens")
                if ids:
                    columns.append(pa.array(tokens, pa.binary()))
                    names.append("ids")
                if offsets:
                    columns.append(pa.array(pieces, pa.list_(pa.int32())))
                    names.append("piece_starts")
                if digests:
                    columns += [pa.array(sha, pa.string()), pa.array(back, pa.string())]
                    names += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return encode


def encode(df: DataFrame, text: str | Column, vocabulary: str, keep: list[str], digests: bool = False, ids: bool = True,
           offsets: bool = True) -> DataFrame:
    """``keep`` and, per row, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers), ``piece_starts`` (where pre-tokens
    start, in code points) and, if asked for, the SHA-256 of the ids and of the bytes decoded from them.

    ``vocabulary``: path of a rank file that the driver can read; its content (below a megabyte) goes with the tasks. A null text
    is empty and has no tokens; a text of any length is worked on in windows. One projection, no shuffle.
    """
    with open(vocabulary, "rb") as file:
        content = file.read()
    made = (["n_tokens"] + ["ids"] * ids + ["piece_starts"] * offsets + ["ids_sha256", "decoded_sha256"] * digests)
    if clash := {c.lower() for c in keep} & set(made):
        raise ValueError(f"kept columns {sorted(clash)} have the names of results")
    inner = df.select(*[df[c] for c in keep], (F.col(text) if isinstance(text, str) else text).cast("binary").alias("__text"))
    types = {"n_tokens": "BIGINT", "ids": "BINARY", "piece_starts": "ARRAY<INT>", "ids_sha256": "STRING", "decoded_sha256": "STRING"}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema if f.name != "__text"]
                       + [f"{c} {types[c]}" for c in made])
    return inner.mapInArrow(_encoder(content, class_table(), digests, ids, offsets), schema)


def _decoder(vocabulary: bytes, ids: str, name: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            tokens = tokens or {rank: token for token, rank in read_ranks(vocabulary).items()}
            at = batch.schema.get_field_index(ids)
            out = [None if (raw := x.as_py()) is None else b"".join(map(tokens.__getitem__, np.frombuffer(raw, "<u4").tolist()))
                   for x in batch.column(at)]
            columns = [c for i, c in enumerate(batch.columns) if i != at] + [pa.array(out, pa.binary())]
            names = [n for i, n in enumerate(batch.schema.names) if i != at] + [name]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return decode


def decode(df: DataFrame, ids: str, vocabulary: str) -> DataFrame:
    """The rows with ``decoded BINARY``: the bytes of their ids; null for null."""
    with open(vocabulary, "rb") as file:
        content = file.read()
    inner_ids, name = fresh(df, "ids_to_decode", "decoded")
    inner = df.withColumn(inner_ids, F.col(ids))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{name} BINARY"])
    return inner.mapInArrow(_decoder(content, inner_ids, name), schema)


def encode_documents(docs: DataFrame, vocabulary: str, ids: bool = False, keep: tuple[str, ...] = (), offsets: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of a documents table, with ``ids`` and ``piece_starts`` if asked for, and the columns ``keep``.

    Null and empty texts have no tokens (digests of nothing). Rows with null or repeated ids are rows like others, further
    columns are not looked at, and an empty table gives an empty result.
    """
    out = encode(docs, "text", vocabulary, ["doc_id", *keep], digests=True, ids=ids, offsets=offsets)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids, *["piece_starts"] * offsets, *keep)


by_value(__name__)
