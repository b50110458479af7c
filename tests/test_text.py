import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from cuewright.functions import regex as R
from cuewright.functions import text as T

NORMALISER = [
    ("می\u200Cشود", "میشود", "میشود"),
    ("كتابي", "کتابی", "کتابی"),
    ("م\u064Fح\u064Eم", "محم", "محم"),
    ("آدرس", "ادرس", "ادرس"),
    ("ا\u0653درس", "آدرس", "آدرس"),  # composed after the fold
    ("ﻱ", "ي", "ي"),  # a presentation form is not folded
    ("ＷＷＷ．com", "WWW.com", "WWWcom"),
    ("ﬁlm", "film", "film"),
    ("@ab 12 http://x.io", "@ab 12 http://x.io", "ab  httpxio"),
    ("a\u00A0b²", "a b2", "a b"),
]


def test_normalize_literals(apply):
    texts = [n[0] for n in NORMALISER]
    assert apply(T.normalize, texts) == [n[1] for n in NORMALISER]
    assert apply(lambda c: T.normalize(c, True), texts) == [n[2] for n in NORMALISER]


def python_normalize(text):
    text = "".join(c for c in text if not (0x200B <= ord(c) <= 0x200F or 0x2060 <= ord(c) <= 0x2069 or c in "\uFEFF\u00AD"))
    text = "".join(c for c in text if not (0x64B <= ord(c) <= 0x652 or ord(c) == 0x670))
    return unicodedata.normalize("NFKC", text.translate(str.maketrans("يكةؤإأآىٱ", "یکهوااایا")))


def random_texts(n, seed, alphabet):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_normalize_against_python(apply):
    assigned = [chr(c) for c in range(1, 0x30000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    texts = random_texts(3000, 1, assigned) + random_texts(1000, 2, "اأآيكة\u064Fـ\u200Cﻱﻙﻼab1 é\u0301\u0653")
    assert apply(T.normalize, texts) == [python_normalize(t) for t in texts]


def test_nfkc_every_assigned_character(apply):
    chars = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    assert apply(T.nfkc, chars) == [unicodedata.normalize("NFKC", c) for c in chars]


def test_strip_and_clean_tags(apply):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    assert sorted(T.SPACE_CHARS) == sorted(spaces)
    texts = ["  \t a b\u3000\n", "", " ", "x"]
    assert apply(T.strip, texts) == [t.strip() for t in texts]
    texts = ["{\\an8}<i>Hi</i>\n there  x {}", "<>a", "a { b", "\x1c a\x85b ", "{a<b}c>d", "<{x>y}z", "{}{a}<b><>"]
    assert apply(T.clean_tags, texts) == ["Hi there x {}", "<>a", "a { b", "a b", "c>d", "<z", "{}<>"]


def test_safe_filename(apply):
    assert apply(T.safe_filename, [' a\\b/c*d?e:f"g<h>i|j ']) == ["a_b_c_d_e_f_g_h_i_j"]


def test_newlines(apply):
    assert apply(T.unix_newlines, ["a\r\nb\rc\n\r\n", "x"]) == ["a\nb\nc\n\n", "x"]


@pytest.mark.parametrize("ruleset, size", [("full", 53), ("lite", 8)])
def test_rules_against_python(apply, ruleset, size):
    rules = R.load_rules(ruleset)
    assert len(rules) == size
    python = re.compile("|".join(f"(?:{p})" for p in rules), re.IGNORECASE)
    pieces = [
        "a", "é", "_", "-", ".", "..", "@", " ", " ", "\u200C", "\n", "²", "٣", "۳۰نما", "30nama", "com", "ir", "COM", "www.", "x", "ad",
        "like", "Like", "liKe", "ſub", "&", "and", "share", "by", "translated", "sub", "http://", "https://", "t.me/", "telegram",
        "زر", "دانلود", "کد", "تخفیف", "کانال", "visit", "us", "join", "the", "click", "link", "free", "download", "buy", "now", "ı", "İ", "K",
        "promo", "sponsor", "mail", "%", "+", "|", "A", "𠀀", "\u0670", "\u0301", "تی", "وی", "check", "out", "-.", "--.",
    ]
    rng = random.Random(7)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 7))) for _ in range(12000)]
    got = apply(lambda c: R.matches_rules(c, ruleset), texts)
    wrong = [t for t, g in zip(texts, got) if g != bool(python.search(t))]
    assert not wrong, [ascii(w) for w in wrong[:10]]
    assert 100 < sum(got) < len(texts) - 100


def test_each_rule_alone_against_python(spark):
    pieces = ["a", "é", "_", "-", ".", "@", " ", "com", "www.", "ad", "like", "&", "and", "by", "sub", "http://", "x", "us", "visit", "\n", "|", "-www"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 7))) for _ in range(6000)]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    rules = R.load_rules()
    rows = df.select("t", *[R.matches_rules(F.col("t"), [p]).alias(f"r{i}") for i, p in enumerate(rules)]).collect()
    for i, p in enumerate(rules):
        compiled = re.compile(p, re.IGNORECASE)
        wrong = [r.t for r in rows if r[f"r{i}"] != bool(compiled.search(r.t))]
        assert not wrong, (p, [ascii(w) for w in wrong[:5]])


def test_long_texts_are_read_once(apply):
    """No recursion per label, no second reading of a run of name characters."""
    import time

    hits = ["a-." * 100_000 + "com", "x@" + "y." * 100_000 + "org", "www." * 100_000 + "com"]
    misses = ["a." * 200_000, "-." * 200_000 + "com", "x@" + "y." * 100_000, " " * 300_000 + "x", "a" * 500_000, "a-" * 200_000 + " x.come",
              "a.b@" * 50_000, "{<" * 100_000, "\n " * 200_000 + "x"]
    started = time.time()
    assert apply(R.matches_rules, hits + misses) == [True] * len(hits) + [False] * len(misses)
    assert apply(T.clean_tags, ["{<" * 100_000 + "a", "{}" * 100_000]) == ["{<" * 100_000 + "a", "{}" * 100_000]
    assert time.time() - started < 60


def test_classes_against_python(apply):
    chars = [chr(c) for c in range(1, 0x20000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    # letters newer than the JVM's Unicode tables are unknown to it
    known = [c for c in chars if unicodedata.ucd_3_2_0.category(c) != "Cn"]
    for token in (r"\s", r"\S", r"\w", r"\d"):
        got = apply(lambda c: c.rlike(r"\A" + R.to_jvm(token) + r"\z"), known)
        wrong = [c for c, g in zip(known, got) if g != bool(re.fullmatch(token, c))]
        assert not wrong, (token, [hex(ord(c)) for c in wrong[:10]])


def test_normalisation_folds_a_text_once(spark):
    """Deleting and folding are one call, whose argument is not worked out again for a test on null; every deleted character is one of the two classes."""
    from cuewright.functions.text import DELETED, DIACRITICS, INVISIBLE, normalize

    assert str(normalize(F.col("text"))).count("translate") == 1
    every = spark.range(1, 0x10000).filter("id < 55296 OR id > 57343").select(F.decode(F.encode(F.expr("concat('é', decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE'), 'é')"), "UTF-8"), "UTF-8").alias("t"))
    gone = every.select(F.length(F.regexp_replace("t", f"{INVISIBLE}|{DIACRITICS}", "")) == 2, F.contains(F.lit(DELETED), F.substring("t", 2, 1))).toDF("a", "b")
    assert gone.filter("a != b").count() == 0 and gone.filter("a").count() == len(DELETED)
    rows = spark.createDataFrame([(None,), ("é​كَ",), ("plain",)], "t string").select(normalize(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [None, "éک", "plain"]
