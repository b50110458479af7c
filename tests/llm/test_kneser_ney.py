"""Probabilities against a direct computation; decisions on odd rows and on the driver's labels."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from cuewright.llm.kneser_ney import _distinct, judge, keep_good, perplexities, probabilities

from .conftest import documents

DATA = "/root/testdata/sf0.01"
PAD = "￿"


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney, straight from the formulas."""
    counts = {order: Counter()}
    for t in texts:
        padded = PAD * (order - 1) + t
        counts[order].update(padded[i:i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    symbols = len(counts[1]) + 1
    discounts, contexts = {}, {}
    for k, table in counts.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else None
        discounts[k] = [0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] and y is not None else 0.5 * i, 0.01), 0.99 * i) for i in (1, 2, 3)]
        contexts[k] = defaultdict(lambda: [0, 0.0])
        for g, c in table.items():
            contexts[k][g[:-1]][0] += c
            contexts[k][g[:-1]][1] += discounts[k][min(c, 3)]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / symbols
        if gram[:-1] not in contexts[k]:
            return p(gram[1:])
        total, taken = contexts[k][gram[:-1]]
        c = counts[k][gram]
        return (max(c - discounts[k][min(c, 3)], 0) + taken * p(gram[1:])) / total
    return p


def test_probabilities(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log, the cat did not", "a mat and a cat and a hat"]
    counts = Counter(g for t in texts for g in ((PAD * 2 + t)[i:i + 3] for i in range(len(t))))
    asked = set(counts) | {"zzz", "the", "xat", "ca#", PAD + PAD + "q", "qq ", "t z"}
    other = Counter(g for g in ((PAD * 2 + texts[1])[i:i + 3] for i in range(len(texts[1]))))
    rows = spark.createDataFrame([("en", g, counts[g], other[g]) for g in asked] + [("xx", "abc", 0, 0)], "lang STRING, gram STRING, c0 BIGINT, c1 BIGINT")
    found = probabilities(rows, 3, (0, 1)).collect()
    p, q = plain_model(texts, 3), plain_model(texts[1:2], 3)
    assert len(found) == len(asked) + 1
    for r in found:
        assert (r.p0, r.p1) == ((pytest.approx(p(r.gram), rel=1e-9), pytest.approx(q(r.gram), rel=1e-9)) if r.lang == "en" else (1.0, 1.0)), r
    seen = {g[2] for g in counts}
    assert sum(p("at" + c) for c in seen) == pytest.approx(1 - (1 / (len(seen) + 1)) * _left(p, "at", seen), rel=1e-6)


def test_plan_does_not_grow_with_the_order(spark, capsys):
    """The driver plans, sends and runs the joins of one order at a time, and none of them is by a language alone."""
    plans = []
    for order in (3, 6):
        rows = spark.createDataFrame([("en", g, 1) for g in ("abcdef"[:order], "bcdefa"[:order])], "lang STRING, gram STRING, c0 BIGINT")
        capsys.readouterr()
        probabilities(rows, order).explain()
        plans.append(capsys.readouterr().out)
    assert plans[0].count("Join") == plans[1].count("Join") == 3
    assert plans[0].count("Exchange") == plans[1].count("Exchange")


def _left(p, context, seen):
    """What the model leaves to symbols it has not seen, in units of the uniform probability."""
    return p(context + "\x01") * (len(seen) + 1)


def test_perplexities(spark):
    good = ["the cat sat on the mat in 1999", "the dog sat on the log\x00, the cat did not", "a mat and a cat and a hat", "Ünïcode 😀 text"]
    rows = [(i, t, "en", "s") for i, t in enumerate(good)] + [(10, "the hat sat", "en", "s"), (11, "#### !!!!", "en", "s"), (12, "", "en", "s")]
    marks = spark.createDataFrame([(i, i % 2) for i in range(len(good))], "doc_id BIGINT, fold INT")
    folded = [t.replace("\x00", "␀").replace("1999", "0000") for t in good]
    models = [plain_model(x, 4) for x in (folded, folded[0::2], folded[1::2])]
    for chars in (32_000_000, 20):
        for r in perplexities(documents(spark, rows), marks, block_chars=chars).collect():
            text = next(t for i, t, *_ in rows if i == r.doc_id).replace("\x00", "␀").replace("1999", "0000")
            padded = PAD * 3 + text
            assert r.n == len(text)
            for m, p in enumerate(models):
                assert r[f"s{m}"] == pytest.approx(-sum(math.log(p(padded[i:i + 4])) for i in range(len(text))), rel=1e-5, abs=1e-9)


@pytest.mark.parametrize("symbols", [40_000, 43_000, 60_000, 140_000])
def test_many_symbols(symbols):
    """Also where three folds of n-grams pass 64 bits, and where n-grams alone do."""
    chart = "".join(map(chr, range(0x20000, 0x20000 + symbols)))
    texts, fold = [chart, chart[::-1] + chart[-5:], chart[-3:]], [1, 2, 1]
    expected = Counter()
    for t, f in zip(texts, fold):
        padded = PAD * 3 + t
        expected.update((padded[i:i + 4], f) for i in range(len(t)))
    grams, counts = _distinct([t.encode() for t in texts], np.array(fold), 4)
    assert len(set(grams)) == len(grams)
    assert {(g, f): int(n) for g, row in zip(grams, counts) for f, n in enumerate(row) if n} == expected


def test_perplexity_of_many_symbols(spark):
    chart = "".join(map(chr, range(0x20000, 0x20000 + 60_000)))
    rows = [(0, chart, "en", "s"), (1, chart[:500] * 2, "en", "s"), (2, chart[100:160] + chart[59_000:59_050], "en", "s")]
    marks = spark.createDataFrame([(1, 0)], "doc_id BIGINT, fold INT")
    found = {r.doc_id: r for r in perplexities(documents(spark, rows), marks).collect()}
    p = plain_model([rows[1][1]], 4)
    for i, text, *_ in rows:
        padded = PAD * 3 + text
        assert found[i].n == len(text)
        assert found[i].s0 == pytest.approx(-sum(math.log(p(padded[k:k + 4])) for k in range(len(text))), rel=1e-5)


def test_labelled_documents(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = {r.doc_id: r.kept for r in judge(docs, labels).collect()}
    marks = labels.collect()
    good = [rows[r.doc_id] for r in marks if r.quality == 1]
    bad = [rows[r.doc_id] for r in marks if r.quality == 0]
    assert len(rows) == docs.count()
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (6, 1, None), (None, 1, 0), (4, 1, 0), (99, 1, 0), (5, None, None)], "doc_id BIGINT, quality INT, toxic INT")
    rows = judge(odd, labels, least=1).collect()
    assert len(rows) == odd.count()
    assert all(r.kept and r.perplexity is None for r in rows if r.n_chars == 0)
    assert all(r.kept and r.threshold is None for r in rows if r.lang in ("ja", "de", ""))
    kept = keep_good(odd, labels)  # too few trusted texts to judge by
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert judge(nothing, labels).collect() == [] and keep_good(nothing, labels).collect() == []
    assert len(judge(odd, labels.limit(0)).collect()) == odd.count()
