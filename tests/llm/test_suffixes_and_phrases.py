"""Repeated strings and phrase fingerprints against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cuewright.llm import lempel_ziv as lz
from cuewright.llm import suffix_dedup
from cuewright.llm.suffix_dedup import repeated_bytes

from .conftest import documents

DATA = "/root/testdata/sf0.001"


def plain_removal(texts, length):
    counts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def made_texts(seed):
    rng = random.Random(seed)
    some = lambda n, alphabet="abcdefgh ": "".join(rng.choice(alphabet) for _ in range(n))
    shared = [some(rng.choice([199, 200, 201, 230, 260, 300, 390, 500, 900])) for _ in range(10)]
    texts = []
    for _ in range(70):
        text = ""
        for _ in range(rng.randint(0, 5)):
            text += some(rng.randint(0, 250), rng.choice(["ab", "abcdefgh ", "é€x"])) + rng.choice(shared)[rng.randint(0, 60):]
        texts.append(text)
    return [*texts, "", "a" * 1000, "ab" * 300, None, texts[3], texts[3], "a" * 450, "xy" * 99 + "z"]


@pytest.mark.parametrize("length, group_rows, chunk", [(200, 20_000, 1 << 22), (200, 4, 1 << 22), (80, 20_000, 300)])
def test_removal(spark, monkeypatch, length, group_rows, chunk):
    """Small groups make gram groups be taken apart into single strings, small chunks cut texts."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    texts = made_texts(length)
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    rows = sorted(repeated_bytes(docs, length, 30_000, group_rows).collect())
    assert [tuple(r)[1:5] for r in rows] == plain_removal([(t or "").encode() for t in texts], length)
    for r, t in zip(rows, texts):
        edges = [0, *r.removed, r.n_bytes]
        raw = (t or "").encode()
        assert hashlib.sha256(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))).hexdigest() == r.kept_sha256


def test_documents_removal(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    given = sorted((r.doc_id, r.text.encode()) for r in docs.collect())
    rows = sorted(repeated_bytes(docs).drop("removed").collect())
    assert [tuple(r)[1:] for r in rows] == plain_removal([t for _, t in given], 200)


def test_odd_rows_removal(odd, nothing):
    rows = repeated_bytes(odd).collect()
    assert len(rows) == odd.count() and sum(r.n_bytes == 0 for r in rows) == 3
    long = next(r for r in rows if r.doc_id == 6)
    assert long.n_removed == long.n_bytes and long.n_spans == 1
    assert repeated_bytes(nothing).collect() == []


def plain_phrases(text):
    seen, out, phrase = set(), [], ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            out.append(phrase)
            phrase = ""
    return out + [phrase] * bool(phrase)


def parsed(text):
    ends = []
    lz.parse(text, 0, set(), ends)
    return ends


def test_phrases():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice("ab c😀") for _ in range(rng.randint(0, 300)))
        ends = parsed(text)
        assert [text[a:b] for a, b in zip([0, *ends], ends)] == plain_phrases(text)


@pytest.mark.parametrize("full", [1 << 20, 10])
def test_pairs(monkeypatch, full):
    monkeypatch.setattr(lz, "FULL", full)
    rng, hasher = random.Random(2), lz.Hasher()
    for _ in range(300):
        text, following = ("".join(rng.choice("ab c") for _ in range(rng.randint(0, 150))) for _ in range(2))
        own, changed, edited = lz.pair(text, following, hasher)
        half = len(text) // 2
        assert edited == text[:len(text) - half] + following[:half]
        assert own.tolist() == hasher.signature(text, parsed(text)).tolist()
        assert changed.tolist() == hasher.signature(edited, parsed(edited)).tolist()


def test_likeness_estimates_shared_phrases():
    rng, hasher = random.Random(3), lz.Hasher()
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    for _ in range(20):
        a = " ".join(rng.choice(words) for _ in range(300))
        b = a[:len(a) // 2] + " ".join(rng.choice(words) for _ in range(150))
        x, y = set(plain_phrases(a)), set(plain_phrases(b))
        estimate = lz.likeness(*(hasher.signature(t, parsed(t)) for t in (a, b)))
        assert abs(estimate - len(x & y) / len(x | y)) < 0.25
    assert lz.likeness(np.zeros(0, np.uint32), np.zeros(0, np.uint32)) == 1.0


@pytest.mark.parametrize("part_chars", [4_000_000, 30_000])
def test_documents_fingerprints(spark, part_chars):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    rows = {r.doc_id: r for r in lz.fingerprints(docs, part_chars).collect()}
    assert len(rows) == len(given)
    hasher = lz.Hasher()
    for (i, text), (j, following) in zip(given, given[1:] + given[:1]):
        own, changed, edited = lz.pair(text, following, hasher)
        assert tuple(rows[i])[1:] == (len(text), hashlib.sha256(edited.encode()).hexdigest(), lz.written(own), lz.written(changed), lz.likeness(own, changed),
                                      lz.likeness(own, hasher.signature(following, parsed(following))))


def test_odd_rows_fingerprints(spark, odd, nothing):
    rows = lz.fingerprints(odd, 100).collect()
    assert len(rows) == odd.count()
    same = {r.fingerprint for r in rows if r.n_chars == len("the same text twice") and r.doc_id in (4, 5)}
    assert len(same) == 1 and all(r.fingerprint == "" for r in rows if r.n_chars == 0)
    assert sorted(r.n_chars for r in rows) == sorted(len(r.text or "") for r in odd.collect())
    assert lz.fingerprints(nothing).collect() == []
    single = lz.fingerprints(documents(spark, [(3, "abcd", "en", "s")])).first()
    assert single.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and single.near_next == 1.0
