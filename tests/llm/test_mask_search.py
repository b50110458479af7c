"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np

from cuewright.llm.mask_search import WORD, Block, ranked, terms_of

from .conftest import documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def brute(docs, items, k=20):
    """Rows by the plain formula; ``docs`` and ``items`` are pairs of id and text."""
    terms = [Counter(TERM.findall((t or "").translate(LOWER))) for _, t in docs]
    documents, words = sum(bool(t) for t in terms), sum(t.total() for t in terms)
    df = Counter(w for t in terms for w in t)
    out = []
    for item, text in dict.fromkeys(items):
        query = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for (doc, _), t in zip(docs, terms):
            m = 75 + 25 * t.total() * documents // words if words else 0
            score = sum(c * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[w] + 1))) * (10**9 * t[w] // (1000 * t[w] + 12 * m))
                        for w, c in query.items() if t[w])
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def table(spark, items):
    return spark.createDataFrame(items, "item_id BIGINT, text STRING")


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def made(seed, n_docs, n_items, vocabulary=300):
    """Terms of Zipf's frequencies, items of few and of more terms than one word has bits, repeated texts for ties."""
    rng = random.Random(seed)
    words = [f"T{i}é" if i % 7 == 0 else f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    text = lambda n: rng.choice([" ", ", ", "-", "  "]).join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(n_docs)]
    docs += [(n_docs + i, docs[rng.randrange(n_docs)][1]) for i in range(n_docs // 4)]
    return docs, [(i, text(rng.choice([1, 3, 10, 40]) if i % 5 else 400)) for i in range(n_items)]


def test_all_scores(spark):
    docs, items = made(1, 400, 25)
    assert max(len(set(terms_of(t.encode()))) for _, t in items) > WORD
    frame = documents(spark, [(i, t, "en", "s") for i, t in docs], False)
    expected = sorted(brute(docs, items), key=str)
    assert rows(ranked(frame, table(spark, items))) == expected
    # small blocks, and items in several sets
    assert rows(ranked(frame, table(spark, items), block=37, postings=200, set_chars=3_000)) == expected
    assert rows(ranked(frame, table(spark, items), k=3)) == sorted(brute(docs, items, 3), key=str)


def test_masks_end_early():
    """The search looks at few masks, and at no fewer than are needed."""
    rng = np.random.default_rng(4)
    n, terms = 20_000, 12
    held = rng.random((n, terms)) < 0.6 ** np.arange(terms)
    sizes = held.sum(axis=1)
    number = np.nonzero(held)[1]
    times = rng.integers(1, 5, len(number))
    block = Block(sizes, rng.integers(20, 400, n), number, times, n, 200 * n)
    query = [(t, 500 * (t + 1)) for t in range(terms)]
    docs, scores = block.best(query, 20, wave=512)
    every = np.zeros(n, np.int64)
    for t, w in query:
        a, b = block.span[t]
        every[block.doc[a:b]] += w * block.factor[a:b]
    cut = np.sort(every)[-20]
    assert sorted(docs) == sorted(np.flatnonzero(every >= cut)) and (every[docs] == scores).all()
    assert len(block.best([(99, 5), (3, 0)], 20)[0]) == 0


def test_odd_rows(spark, odd, nothing):
    items = [(0, "the same TEXT"), (0, "the same TEXT"), (0, "no id"), (1, None), (2, ""), (3, " .,-"), (None, "words of text 日本語"), (5, "absent"), (6, "4012888888881881 word")]
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows(ranked(odd, table(spark, items))) == sorted(brute(texts, items), key=str)
    assert rows(ranked(nothing, table(spark, items))) == [] and rows(ranked(odd, table(spark, []))) == []
    more = table(spark, items).selectExpr("*", "1 AS query", "2 AS rank", "3 AS score", "4 AS doc_id")
    assert rows(ranked(odd, more)) == sorted(brute(texts, items), key=str)


def test_terms():
    text = "It's 3.5µm — naïve_ID Ünï\x00x \x7f ÀB"
    assert terms_of(text.encode()) == [t.encode() for t in TERM.findall(text.translate(LOWER))]
