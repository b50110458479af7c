"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from cuewright.llm.simhash import components, connect, fingerprint, near_duplicates, near_links, without_near_duplicates

DATA = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_of_component(values):
    x = np.array(values, np.uint64)
    u, v = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    return connect(len(x), u, v)


def test_fingerprints():
    rng = random.Random(3)
    texts = ["", " \t\n", "One", "A b C", "a b c d", "É é x y z w\x1cq", *("".join(rng.choice("aB é\n") for _ in range(200)) for _ in range(100))]
    assert [fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("leaf_rows, count", [(2_048, None), (16, None), (2_048, 1 << 40)])
def test_links(spark, leaf_rows, count):
    """Clusters of copies and far values; small leaves make Spark go down the trie, a large count takes more pieces."""
    rng = np.random.default_rng(3)
    values = {0}
    for base in rng.integers(0, 2**63, 8, dtype=np.uint64):
        for _ in range(60):
            x = int(base)
            for bit in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(bit)
            values.add(x)
    values = np.array(sorted(values), np.uint64).view(np.int64)
    values.sort()
    roots = least_of_component(values.view(np.uint64))
    df = spark.createDataFrame([(int(x),) for x in values], "fp BIGINT").coalesce(2)
    found = {r.node: r.root for r in components(near_links(df, 4, leaf_rows, count)).collect()}
    least = {}
    for x, r in zip(values, roots):
        least[r] = min(least.get(r, 1 << 64), int(x))
    assert {int(x): found.get(int(x), int(x)) for x in values} == {int(x): least[r] for x, r in zip(values, roots)}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    rng = random.Random(1)
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a BIGINT, b BIGINT").coalesce(2)).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 140)}}


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in given]
    ids = np.array([r.doc_id for r in given])
    roots = least_of_component(prints)
    expected = {int(i): (p, int(ids[roots == r].min())) for i, p, r in zip(ids, prints, roots)}
    found = near_duplicates(docs).collect()
    assert {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in found} == expected and len(found) == len(given)
    kept = [r.doc_id for r in without_near_duplicates(docs).collect()]
    assert sorted(kept) == sorted({c for _, c in expected.values()})


def test_odd_rows(odd, nothing):
    found = near_duplicates(odd).collect()
    assert len(found) == odd.count()
    empty = [r for r in found if r.fp == 0]
    assert len(empty) == 3 and {r.component_id for r in empty} == {1}  # two nulls and an empty text
    assert {r.component_id for r in found if r.doc_id == 5} == {4}
    kept = without_near_duplicates(odd)
    rows = kept.collect()
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:12]) for r in rows) == [
        (False, 0, "A first text"), (False, 1, ""), (False, 4, "the same id,"), (False, 4, "the same tex"), (False, 6, "word and ano"), (False, 8, "naïve 日本語 😀 "),
        (False, 9, "x"), (True, 0, "no id here a")]
    assert near_duplicates(nothing).collect() == [] and without_near_duplicates(nothing).collect() == []
