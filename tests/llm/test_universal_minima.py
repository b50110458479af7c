"""Groups of near copies against brute force over all pairs."""

import random

import numpy as np
import pytest

from cuewright.llm import universal_minima
from cuewright.llm.queries import op11_universal_minhash
from cuewright.llm.simhash import connect
from cuewright.llm.universal_minima import by_sets, by_signature, forest, near_copies

from .conftest import documents


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute(rows, k, percent=80):
    """``(n_shingles, component_id, kept)`` of every row; ids are numbers."""
    sets = [shingles(t, k) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    u, v = np.array(links, int).reshape(-1, 2).T
    label = connect(len(rows), u, v)
    least = {}
    for (doc_id, _), root in zip(rows, label):
        least[root] = min(least.get(root, doc_id), doc_id)
    return [(i, len(s), least[r], i == least[r]) for (i, _), s, r in zip(rows, sets, label)]


def planted(seed=5):
    """Hubs with copies that differ from one another more than from the hub, copies of short texts, exact copies, and common passages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5_000)}"
    common = [word() for _ in range(120)]
    texts = ["", " \n ", "one", "ONE", "two words", "Two Words", "a b c d e f", "a b c d e g"]
    for n in range(30):
        base = [word() for _ in range(rng.randint(3, 250))] + (common if n % 3 == 0 else [])
        texts += [" ".join(base)] * rng.randint(1, 3)
        for share in (0.02, 0.05, 0.05, 0.06, 0.06, 0.1):
            copy = list(base)
            for i in rng.sample(range(len(copy)), int(share * len(copy))):
                copy[i] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("k, block, members", [(2, 3, 10_000), (2, 2_048, 300), (5, 2_048, 1 << 21)])
def test_planted_copies(spark, k, block, members):
    rows = planted()
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows], False)
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_copies(docs, k, block=block, members=members).collect()]
    assert sorted(found) == brute(rows, k)
    sizes = [len([r for r in found if r[2] == c]) for c in {r[2] for r in found}]
    assert max(sizes) > 4 and len(sizes) > 30


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = op11_universal_minhash(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == sorted(brute([(r.doc_id, r.text) for r in docs], 2))


def test_odd_rows(odd, nothing):
    found = near_copies(odd, 2).collect()
    assert near_copies(odd, 2).columns == ["doc_id", "key", "n_shingles", "component_id", "kept"]
    rows = {(r.doc_id, r.key): r for r in found}
    assert len(found) == odd.count()
    # null and empty texts are alone, whoever else is empty
    assert all(r.kept and r.component_id == r.doc_id and r.n_shingles == 0 for r in found if r.key in (None, "d41d8cd98f00b204e9800998ecf8427e"))
    same = [(r.doc_id, r.component_id, r.kept) for r in found if r.n_shingles == 3 and r.doc_id in (4, 5)]
    assert sorted(same) == [(4, 4, True), (4, 4, True), (5, 4, False)]
    assert rows[None, None].kept and near_copies(nothing, 2).collect() == []


def test_forest_of_signatures():
    rng = np.random.default_rng(2)
    hub = rng.integers(0, 256, universal_minima.SIGNATURE).astype(np.uint8)
    spokes = np.stack([hub] * 9)
    for i, row in enumerate(spokes[1:]):
        row[i * 15:i * 15 + 15] += 1
    rows = spokes[[3, 5, 0, 1, 2, 4, 6, 7, 8]]
    edges = forest(9, by_signature(rows, 110))  # a spoke has 113 bytes of the hub and 98 of another spoke
    assert len(edges) == 8 and all(2 in e for e in edges)


def test_forest_of_sets():
    rng = random.Random(8)
    sets = []
    for _ in range(25):
        base = rng.sample(range(10_000), rng.randint(1, 60))
        for _ in range(8):
            sets.append(sorted({rng.randrange(10_000) if rng.random() < 0.1 else x for x in base}))
    every = lambda at, others: np.ones(len(others), bool)
    near = by_sets(np.concatenate(sets), np.array([len(x) for x in sets]), 80, every)
    edges = forest(len(sets), near)
    true = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))]
    assert {(max(e), min(e)) for e in edges} <= set(true) and len(edges) < len(true)
    both = [connect(len(sets), *np.array(x).T) for x in (edges, true)]
    assert (both[0] == both[1]).all() and len(set(both[0])) == len(sets) - len(edges)


def test_minima_estimate_similarity():
    family = universal_minima.Family()
    x = universal_minima.scramble(np.arange(1, 1_001, dtype=np.uint64))
    agree = (family.minima(x[:900]) == family.minima(x[100:])).mean()
    assert abs(agree - 0.8) < 0.1
    assert (family.band_keys(family.minima(x)) == family.band_keys(family.minima(x[::-1]))).all()
