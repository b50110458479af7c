"""Runs of words against a search over all periods."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cuewright.llm.periodic_runs import looped, periodic_runs, run_digests, runs_of, successors
from cuewright.llm.queries import op13_basic_factors

from .conftest import documents


def brute(words, least=6, periods=4):
    """All runs by comparing the text with itself at every distance; a stretch also has the runs of its divisors' periods."""
    out = []
    for q in range(1, len(words) // periods + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            if not s and start is not None:
                n = i + q - start
                part = words[start:start + n]
                if n >= max(least, periods * q) and not any(part[:-d] == part[d:] for d in range(1, q)):
                    out.append((start, n, q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    """The contract's row by the contract's words."""
    words = (text or "").encode().split()
    n = len(words)
    if n and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    keep = [not any(s + q <= i < s + n_ for s, n_, q in runs) for i in range(n)]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for w, k in zip(words, keep) if k)).hexdigest())


def of_all(texts, **settings):
    sizes = np.array([len(t) for t in texts], int)
    text, *rest = runs_of(np.array([w for t in texts for w in t], int), sizes, **settings)
    out = [[] for _ in texts]
    for t, *r in zip(text.tolist(), *(c.tolist() for c in rest)):
        out[t].append(tuple(r))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5))
def test_any_words(texts):
    assert of_all(texts) == [brute(t) for t in texts]
    assert of_all(texts, least=1, periods=3) == [brute(t, 1, 3) for t in texts]


def test_runs_in_text():
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        words = [rng.randrange(1_000) for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 4)):
            q = rng.randint(1, 40)
            root = [rng.randrange(3 if rng.random() < 0.5 else 1_000) for _ in range(q)]
            at = rng.randint(0, len(words))
            words[at:at] = (root * 8)[:rng.randint(3 * q, 8 * q)]
        texts.append(words)
    found = of_all(texts)
    assert found == [brute(t) for t in texts]
    assert sum(map(len, found)) > 60 and max(q for f in found for *_, q in f) > 30
    # a long text of one word, and one that alternates at two scales
    assert of_all([[1] * 100_000, ([1, 2] * 5 + [3]) * 9]) == [[(0, 100_000, 1)], brute(([1, 2] * 5 + [3]) * 9)]


def test_successors():
    assert successors(np.array([5, 7, 5, 5, 7, 1])).tolist() == [2, 4, 3, 6, 6, 6]


def test_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    # the search over all periods takes its time with long texts
    short = [r for r in rows if len(r.text or "") < 3_000]
    found = {r.doc_id: tuple(r) for r in op13_basic_factors(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(rows) and len(short) > 120
    assert [found[r.doc_id] for r in short] == [plain(r.doc_id, r.text) for r in short]
    assert sum(r[1] > 0 for r in found.values()) > 10


def test_odd_rows(spark, odd, nothing):
    found = periodic_runs(odd)
    assert found.columns == ["doc_id", "key", "n_words", "runs", "collapsed"]
    assert sorted(map(str, (tuple(r) for r in run_digests(periodic_runs(looped(odd))).collect()))) == sorted(
        str(plain(r.doc_id, r.text)) for r in odd.collect())
    long = next(r for r in found.collect() if r.doc_id == 6)
    assert [tuple(r) for r in long.runs] == [(0, 40_000, 5)] and long.collapsed == "word and another word, 4012888888881881."
    assert run_digests(periodic_runs(nothing)).collect() == [] and looped(odd).columns == odd.columns
    # texts of one batch are worked on in portions
    texts = documents(spark, [(i, "a b " * i + "c", "en", "s") for i in range(30)], False)
    whole, portions = (sorted(map(str, periodic_runs(texts, room=r).collect())) for r in (1 << 19, 7))
    assert whole == portions
