"""Top-k search against brute force; archives against their own format."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.llm.vafile import nearest
from cuewright.llm.warc import LoserTree, archive_pages, classify, read_archives, record_text, url_key, write_archives

DATA = "/root/testdata/sf0.01"


def plain_nearest(rows, k):
    """``rows``: id and vector; queries are the ids divisible by 100."""
    ints = list({(i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)) for i, v in rows})
    out = []
    for q, v in ints:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q and len(w) == len(v))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def found(df, **settings):
    return sorted(map(tuple, nearest(df, F.col("vec_id") % 100 == 0, **settings).collect()))


def test_embeddings(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    assert found(df) == plain_nearest([(r.vec_id, r.embedding) for r in df.collect()], 10)


@pytest.mark.parametrize("cells", [4, 256])
def test_ties_and_blocks(spark, cells):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5]) for _ in range(3)]) for i in range(450)] + [(i, [0.25, 0.5, -1.0]) for i in range(1000, 1400)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert found(df, k=7, block_rows=5, query_rows=2, cells=cells) == plain_nearest(rows, 7)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]), (5, [0.5, 0.5]),
            (6, [1.0, 2.0, 3.0]), (7, []), (100, []), (200, [3.0, -1.0]), (300, [9.0])]
    df = spark.createDataFrame([(*r, "?", 1) for r in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>, key STRING, block INT")
    sound = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert found(df) == plain_nearest(sound, 10)
    assert found(df.limit(0)) == []
    with pytest.raises(Exception, match="too large"):
        found(spark.createDataFrame([(1, [1e30])], "vec_id BIGINT, embedding ARRAY<FLOAT>"))


def plain_archive(rows):
    """``(page_id, bytes, digest, type, refers_to)`` of ``(page_id, url, html)`` rows with different ids."""
    least, out = {}, []
    body = {r[0]: (r[2] or "").encode() for r in rows}
    for i in sorted(body, key=lambda i: (i is None, i or 0)):
        least.setdefault(body[i], i)
    for i, raw in body.items():
        revisit = len(raw) >= 100 and least[raw] != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", least[raw] if revisit else None))
    return sorted(out, key=str)


def test_archives(spark):
    rng = random.Random(6)
    bodies = ["x" * 99, "y" * 100, "é\r\n\r\nWARC/1.0\r\n" * 20, "", "z" * 5000]
    rows = [(i, f"http://h{i % 3}.example.com/{rng.randint(0, 5)}?q#f", rng.choice(bodies)) for i in range(60)]
    rows += [(100, None, None), (101, "http://a\r\nb", "long enough " * 20), (None, "u", "long enough " * 20), (102, "http://www.h1.example.com", "\x00\x85 " * 50)]
    pages = spark.createDataFrame([(*r, "?", 1) for r in rows], "page_id BIGINT, url STRING, html STRING, digest STRING, origin INT").repartition(5)
    done = archive_pages(pages).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in done], key=str) == plain_archive(rows)
    ordered = sorted(done, key=lambda r: r.capture_no)
    assert [r.capture_no for r in ordered] == list(range(len(rows)))
    assert [r.url_key for r in ordered] == sorted(r.url_key for r in ordered)
    assert archive_pages(pages.limit(0)).collect() == []


def test_repeated_rows_are_responses(spark):
    body = "b" * 200
    pages = spark.createDataFrame([(1, "u", body), (1, "u", body), (2, "u", body)], "page_id BIGINT, url STRING, html STRING")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in archive_pages(pages).collect()) == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_record_form(spark, tmp_path):
    pages = spark.createDataFrame([(7, "http://x.org/a", "<p>é</p>")], "page_id BIGINT, url STRING, html STRING")
    rows = classify(pages, F.timestamp_seconds(F.lit(0)))
    text = rows.select(record_text(rows).alias("t")).first().t
    head, http, body = text.split("\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
    assert head.startswith("WARC/1.0\r\n") and body == "<p>é</p>"
    assert fields["WARC-Type"] == "response" and fields["WARC-Date"] == "1970-01-01T00:00:00Z" and fields["WARC-Target-URI"] == "http://x.org/a"
    assert int(fields["Content-Length"]) == len((http + "\r\n\r\n" + body).encode())
    write_archives(pages, str(tmp_path / "w"), F.timestamp_seconds(F.lit(0)))
    assert read_archives(spark, str(tmp_path / "w")).first().payload_bytes == 9


def test_url_keys(apply):
    assert apply(url_key, ["http://www.B.example.com:80/X?y=1#z", "https://a.b/", "mailto:x", None]) == ["com,example,b)/x?y=1", "b,a)/", "mailto:x", ""]


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 7, 16])
def test_loser_tree(runs):
    rng = random.Random(runs)
    data = [sorted((rng.randint(0, 9), rng.random()) for _ in range(rng.randint(0, 30))) for _ in range(runs)]
    assert list(LoserTree([iter(d) for d in data])) == sorted(x for d in data for x in d)


@pytest.mark.parametrize("kind, ids", [("BIGINT", [1, 400_000_000_000, 10**13, 1 << 62, -(1 << 62), -1, None]), ("STRING", ["a", "17", "b-2", None])])
def test_any_page_id(spark, kind, ids):
    """Hashed, negative and worded ids: a record each, and the numbers of captures have no gaps."""
    rows = [(i, "http://x.org/a", f"<p>{n}</p>") for n, i in enumerate(ids)]
    done = archive_pages(spark.createDataFrame(rows, f"page_id {kind}, url STRING, html STRING")).collect()
    assert sorted(map(str, (r.page_id for r in done))) == sorted(map(str, ids))
    assert sorted(r.capture_no for r in done) == list(range(len(ids))) and all(r.record_type == "response" for r in done)
    assert {r.payload_digest for r in done} == {hashlib.sha256(h.encode()).hexdigest() for *_, h in rows}
    if kind == "BIGINT":  # by time: the id modulo the span, whatever its size
        order = [r.page_id or 0 for r in sorted(done, key=lambda r: r.capture_no)]
        assert [i % (1 << 37) for i in order] == sorted(i % (1 << 37) for i in order)
