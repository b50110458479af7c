"""Base spans against Python's own search; what the trees add; redaction."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cuewright.llm.pii import KINDS, base_spans, find_pii, fit, propose, redact

from .conftest import documents

DATA = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text, kind):
    def holds(match):
        digits = [int(c) for c in match if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            odd, even = digits[-1::-2], digits[-2::-2]
            return 13 <= len(digits) <= 19 and (sum(odd) + sum(sum(divmod(2 * d, 10)) for d in even)) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15
    return [(m.start(), m.end()) for m in re.finditer(PLAIN[kind], text) if holds(m.group())]


def listed(text):
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in plain_spans(text, k))


def test_base_spans(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("a.b@c1 2-3+(4)5.6\n7é😀") for _ in range(rng.randint(0, 120))) for _ in range(2000)]
    texts += ["1" * 3000 + ".", "a" * 5000 + "@x", "+" + "1 " * 4000, "4012 8888 8888 1881 x", "a@b.c%d@e.fg", "1.2.3.4.5.6.7.8 256.1.1.1 00000000000001.2.3.0255",
              "99999999999999999999.1.1.1", "x" * 9999 + " me@host.org " + "😀" * 5000 + "+1 (555) 123-4567", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    spans = [F.transform(base_spans(F.col("text"), k), lambda m: F.array(m["start"], m["end"])).alias(k) for k in KINDS]
    for r in df.select("i", *spans).collect():
        assert {k: [tuple(x) for x in r[k]] for k in KINDS} == {k: plain_spans(texts[r.i], k) for k in KINDS}, texts[r.i]


@pytest.mark.parametrize("text", ["at 1.0012.0034.5 now", "0010.0020.0030.0040", "x 7.0000000001.2.3", "1.2.0000300.4 1.00001.00002.3"])
def test_zero_padded_addresses(spark, text):
    """The only address of a text, with long middle parts."""
    row = find_pii(documents(spark, [(1, text, "en", "s")])).first()
    assert row.n_ip == len(plain_spans(text, "ip")) and row.base_sha256 == hashlib.sha256(listed(text).encode()).hexdigest()


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in find_pii(docs).collect():
        base = listed(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(plain_spans(texts[r.doc_id], k)) for k in KINDS)
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    clean = redact(docs).collect()
    assert all(r.text == texts[r.doc_id] or re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r.text) for r in clean)
    assert not any(plain_spans(r.text, k) for r in clean for k in KINDS)
    assert all((r.text == texts[r.doc_id]) == (listed(texts[r.doc_id]) == "") for r in clean)


def test_trees_add_what_looks_like_base_spans(spark):
    """Phones without the plus sign are told from other numbers by their form and what stands before."""
    rng = random.Random(4)
    digits = lambda *n: "".join(rng.choice("123456789") for _ in range(rng.choice(n)))
    blank = lambda: rng.choice(["", " "])
    rows = []
    for i in range(1200):
        if i % 3 == 0:
            rows.append((i, f"call me at +{digits(1, 2)}{blank()}({digits(2, 3)}){blank()}{digits(3)}{rng.choice('- ')}{digits(3, 4)} today", "en", "s"))
        elif i % 3 == 1:
            rows.append((i, f"{rng.choice(['order', 'call'])} {digits(2, 3, 4)}{rng.choice('- ')}{digits(3, 4)}{rng.choice('- .')}{digits(3, 4)} came", "en", "s"))
        else:
            rows.append((i, f"nothing here {i}", "en", "s"))
    rows.append((5000, "call me at 12 (123) 555-4567 today", "en", "s"))
    rows.append((5001, "order 123456789 came", "en", "s"))  # unlike all that is known
    docs = documents(spark, rows)
    model = fit(propose(docs, [F.col("doc_id").alias("__id")]).drop("__text"))
    assert "phone" in model.thresholds and "card" not in model.thresholds
    found = {r.doc_id: r for r in find_pii(docs).collect()}
    assert found[5000].spans == "phone:11:28" and found[5000].n_phone == 0
    assert all(found[i].spans == listed(t) for i, t, *_ in rows[:1200])
    assert {r.doc_id: r.text for r in redact(docs).collect()}[5000] == "call me at [PHONE] today"


def test_odd_rows(spark, odd, nothing):
    found = find_pii(odd).collect()
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    assert len(found) == odd.count()
    assert sorted(r.base_sha256 for r in found) == sorted(hashlib.sha256(listed(r.text or "").encode()).hexdigest() for r in odd.collect())
    out = redact(odd)
    rows = out.collect()
    assert out.columns == odd.columns and len(rows) == odd.count()
    assert {(r.doc_id, r.text) for r in rows if r.doc_id not in (0, 6)} == {x for x in texts if x[0] not in (0, 6)}
    long = next(r for r in rows if r.doc_id == 6)
    assert long.text == "word and another word, [CARD]. " * 8_000 and long.n_chars == len(long.text)
    assert next(r.text for r in rows if r.doc_id == 0) == "A first text of some words, mail [EMAIL] now."
    assert find_pii(nothing).collect() == [] and redact(nothing).collect() == []


@pytest.mark.parametrize("spans, expected", [("+123456789012 a@b.cd", "[PHONE] [EMAIL]"), ("x4012888888881881@h.org", "[EMAIL]"), ("", "")])
def test_overlaps(spark, spans, expected):
    assert redact(documents(spark, [(1, spans, "en", "s")])).first().text == expected
