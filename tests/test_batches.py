"""Grams of many texts at once against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuewright.ml import batches, features, model


def grams(text, lo, hi):
    return [text[i:i + n] for n in range(lo, hi + 1) for i in range(len(text) - n + 1)]


# parts of one character, prefixes in place of digits: all ways lead to the same counts
@pytest.mark.parametrize("chunk, limit, small", [(1 << 20, 1 << 62, 1 << 22), (50, 1 << 20, 1 << 8), (7, 1 << 62, 1), (1, 1 << 20, 1 << 22)])
@pytest.mark.parametrize("lo, hi", [(1, 2), (3, 4), (3, 6)])
@pytest.mark.parametrize("letters", ["ab ", "abé𝒳日\0z" * 3 + "cdefghijklmnopq"])
def test_counts_and_vectors(monkeypatch, chunk, limit, small, lo, hi, letters):
    for name, value in {"CHUNK": chunk, "LIMIT": limit, "SMALL": small}.items():
        monkeypatch.setattr(batches, name, value)
    rng = random.Random(lo * hi + chunk)
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 5, 40, 200]))) for _ in range(40)] + [None, ""]
    n, df = Counter(), Counter()
    for batch in batches.count_grams(iter([pa.record_batch([pa.array(texts)], ["t"])]), lo, hi):
        for r in batch.to_pylist():
            n[r["gram"]] += r["n"]
            df[r["gram"]] += r["df"]
    assert n == Counter(g for t in texts for g in grams(t or "", lo, hi))
    assert df == Counter(g for t in texts for g in set(grams(t or "", lo, hi)))
    known = [g for g, _ in n.most_common(200)]
    rng.shuffle(known)
    scale, coefficients = [1 + rng.random() for _ in known], np.array([rng.random() for _ in known])
    for sublinear in (False, True):
        weights = batches.Weights(known, scale, lo, hi, sublinear)
        products = weights.products(texts, coefficients)
        for text, vector, product in zip(texts, weights.vectors(texts).to_pylist(), products):
            counts = Counter(known.index(g) for g in grams(text or "", lo, hi) if g in known)
            plain = {i: ((1 + math.log(k)) if sublinear else k) * scale[i] for i, k in counts.items()}
            norm = math.sqrt(sum(w * w for w in plain.values())) or 1.0
            assert (vector["type"], vector["size"], vector["indices"]) == (0, len(known), sorted(plain))
            assert vector["values"] == pytest.approx([plain[i] / norm for i in sorted(plain)], abs=1e-12)
            assert product == pytest.approx(sum(w / norm * coefficients[i] for i, w in plain.items()), abs=1e-9)


def test_occurrences_alone():
    """Occurrences counted without their texts are those of a plain count, for few and many characters and texts of several parts."""
    import random
    from collections import Counter

    import pyarrow as pa

    from cuewright.ml.batches import CHUNK, count_occurrences, summed

    rng = random.Random(3)
    wide = ["".join(chr(0x4E00 + rng.randrange(6_000)) for _ in range(5_000)) for _ in range(3)]
    for texts in ([None, "", "a", "ab", "aaaa", "é\U0001F600x\U0001F600x"], [*wide, None, wide[0]], ["abcd" * (CHUNK // 4 + 10), "abc"], [], [""]):
        want = Counter(t[i:i + n] for t in texts if t for n in (1, 3, 4) for i in range(len(t) - n + 1))
        for lo, hi in ((3, 4), (1, 1)):
            got = Counter()
            for out in summed(count_occurrences([pa.record_batch([pa.array(texts, pa.string())], ["t"])], lo, hi), 5_000):
                for gram, k in zip(out.column("gram").to_pylist(), out.column("n").to_pylist()):
                    got[gram] += k
            assert got == Counter({g: k for g, k in want.items() if lo <= len(g) <= hi})


def test_grams_are_counted_for_many_texts_in_one_call():
    """Rows of a batch with the columns before the text, cut at ``ROWS``; no string for an occurrence."""
    import random
    from collections import Counter

    import pyarrow as pa

    from cuewright.ml import batches

    rng = random.Random(4)
    texts = ["".join(rng.choices("aé😀b ", k=rng.randint(0, 60))) if i % 9 else None for i in range(200)]
    batch = pa.record_batch([pa.array(range(200)), pa.array([f"s{i % 3}" for i in range(200)]), pa.array(texts, pa.string())], ["id", "fold", "_t"])
    before, batches.ROWS = batches.ROWS, 1_000
    try:
        made = list(batches.count_in_texts(iter([batch, batch.slice(0, 0)]), 3, 4))
    finally:
        batches.ROWS = before
    assert len(made) > 2 and all(b.num_rows <= 1_000 and b.schema.names == ["id", "fold", "gram", "tf"] for b in made)
    got = [tuple(r.values()) for b in made for r in b.to_pylist()]
    expected = {(i, f"s{i % 3}", g): n for i, t in enumerate(texts) for g, n in Counter((t or "")[a:a + k] for k in (3, 4) for a in range(len(t or "") - k + 1)).items()}
    assert {r[:3]: r[3] for r in got} == expected and len(got) == len(expected)


def test_short_texts_make_no_array_of_grams(spark):
    from cuewright.ml import features

    docs = spark.createDataFrame([(1, "abcabc")], "id INT, clean_text STRING")
    plan = features.text_grams(docs, 3, 4, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sort_array" not in plan and "lambdafunction" not in plan.split("Aggregate")[0]
