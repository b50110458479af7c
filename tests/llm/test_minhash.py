"""Groups of similar documents against brute force, with copies planted at 0.8 to 0.95."""

import random

import numpy as np

import corpus_pipeline
from cuewright.llm.minhash import similar_documents
from cuewright.llm.simhash import connect, near_links, without_near_duplicates

from .conftest import documents


def shingles(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def planted():
    """Bases with copies in which some words are others, so that 0.74 to 0.96 of the shingles are shared."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10_000)}"
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(150, 400))]
        texts.append(" ".join(base))
        for share in (0.01, 0.015, 0.02, 0.023, 0.03):
            copy = list(base)
            for i in rng.sample(range(len(copy)), max(1, int(share * len(copy)))):
                copy[i] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_planted_copies(spark):
    texts = planted()
    sets = [shingles(t) for t in texts]
    pairs = [(i, j, s) for i in range(len(sets)) for j in range(i) if (s := similarity(sets[i], sets[j])) > 0.5]
    assert sum(0.8 <= s < 0.95 for *_, s in pairs) > 80 and sum(s < 0.8 for *_, s in pairs) > 80
    near = np.array([(i, j) for i, j, s in pairs if s >= 0.8])
    roots = connect(len(texts), near[:, 0], near[:, 1])
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)], False)
    found = {r.doc_id: r.root for r in similar_documents(docs).collect()}
    assert len({(found[i], roots[i]) for i in range(len(texts))}) == len(set(found.values())) == len(set(roots))
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({int(r) for r in roots})


def test_odd_rows(odd, nothing):
    found = similar_documents(odd).collect()
    assert len(found) == odd.count()
    assert len({r.root for r in found if r.key in (None, "d41d8cd98f00b204e9800998ecf8427e")}) == 1
    assert len({r.root for r in found}) == 8
    assert without_near_duplicates(odd, similar_documents).columns == odd.columns
    assert similar_documents(nothing).collect() == []


def test_the_stage_goes_through_the_trie(spark, monkeypatch):
    """Without any band the SimHash trie alone finds the closest copies, and no pair below the similarity."""
    from cuewright.llm import minhash

    texts = planted()
    sets = [shingles(t) for t in texts]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)], False)
    asked = []
    monkeypatch.setattr(minhash, "near_links", lambda prints, budget: asked.append(budget) or near_links(prints, budget))
    signer = minhash._signer

    def without_bands(shingle):
        run = signer(shingle)
        def blind(batches):
            import pyarrow as pa
            for n, batch in enumerate(run(batches)):
                none = pa.array([[]] * batch.num_rows, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], none], names=batch.schema.names)
        return blind

    monkeypatch.setattr(minhash, "_signer", without_bands)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()}
    gone = set(range(len(texts))) - kept
    assert asked == [4] and len(gone) > 5
    assert all(any(similarity(sets[i], sets[j]) >= 0.8 for j in range(len(texts)) if j != i) for i in gone)


def one_word_changed(n):
    """Texts of 60 words that are others in one place each: alike (0.8) if the places are at most one apart, else at about 0.7."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    places = [rng.choice([*range(6, 24), *range(26, 56, 6)]) for _ in range(n)]
    return [" ".join([*base[:at], f"x{i}", *base[at + 1:]]) for i, at in enumerate(places)]


def test_a_large_group_makes_no_row_for_a_pair(spark, monkeypatch):
    """Of texts that mostly agree in a band and are not alike no table of pairs is made, and all links between them are found."""
    from cuewright.llm import minhash

    texts = one_word_changed(300)
    sets = [shingles(t) for t in texts]
    near = np.array([(i, j) for i in range(len(sets)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8])
    roots = connect(len(texts), near[:, 0], near[:, 1])
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)], False)
    counts, stored = {}, minhash.stored

    def counted(df, purpose):
        out = stored(df, purpose)
        counts[purpose] = max(out.count(), counts.get(purpose, 0))
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    found = {r.doc_id: r.root for r in similar_documents(docs).collect()}
    assert len({(found[i], roots[i]) for i in range(len(texts))}) == len(set(found.values())) == len(set(roots)) > 3
    assert max(counts.values()) <= minhash.BANDS * len(texts), counts


def test_blocks_lose_no_pair(spark):
    """Buckets and families in blocks of a few texts give the groups that whole ones give."""
    texts = one_word_changed(120) + planted()
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)], False)
    whole, cut = ({r.doc_id: r.root for r in similar_documents(docs, **x).collect()} for x in ({}, {"block": 4, "members": 300}))
    assert whole == cut


def test_rows_of_the_most_frequent_root_are_not_dealt_to_one_another(spark):
    """A group that is connected but for two texts is dealt out in proportion to its size; each of the two meets all others."""
    from cuewright.llm.minhash import _dealt

    rows = spark.range(1_002).selectExpr("1L AS family", "id AS node", "10 AS size", "CASE WHEN id < 1000 THEN 0L ELSE id END AS root", "x'00' AS signature")
    dealt = [(r.bucket, r.node) for r in _dealt(rows, "family", 20, 1 << 62).collect()]
    buckets = {}
    for bucket, node in dealt:
        buckets.setdefault(bucket, set()).add(node)
    assert len(dealt) <= 1_000 + 2 * 51
    assert all(any({a, b} <= nodes for nodes in buckets.values()) for a in (1_000, 1_001) for b in range(1_002) if a != b)
