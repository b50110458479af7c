"""Ids against the public library, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cuewright.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as file:
        return bpe.Codec(file.read(), bpe.class_table())


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, texts):
    return [np.frombuffer(e, "<u4").tolist() for e, _ in codec.encode(texts)]


@pytest.mark.parametrize("alphabet", ["ab's tredlvmST\n\t    '''12٣²½é中文字😀!?.#\x1c\x85　", "'stredvlm ", " \n\ta", "́a1! \x00"])
def test_random_texts(codec, library, alphabet):
    rng = random.Random(alphabet)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    assert ids(codec, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_pieces_and_windows(codec, library, monkeypatch):
    rng = random.Random(1)
    texts = ["ab" * 3000, "".join(rng.choice("abcd") for _ in range(4000)), " " * 999 + "x", "don't 'tis 're' 'VE they'll", ""]
    expected = [library.encode_ordinary(t) for t in texts]
    assert ids(codec, texts) == expected
    monkeypatch.setattr(bpe, "WINDOW", 7)
    assert ids(codec, texts) == expected


def test_both_merges_agree(codec):
    rng = random.Random(2)
    for _ in range(300):
        raw = bytes(rng.choice(b"thein grs") for _ in range(rng.randint(1, 60)))
        assert codec.merger._short(raw) == codec.merger._long(raw)


def test_offsets(codec):
    text = "Hello, wörld's  end\n"
    (_, starts), = codec.encode([text])
    pieces = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
    assert pieces == ["Hello", ",", " wörld", "'s", " ", " end", "\n"]


def test_odd_rows(spark, odd, nothing, library):
    rows = bpe.encode_documents(odd, PATH, ids=True).collect()
    assert len(rows) == odd.count()
    texts = sorted(r.text or "" for r in odd.collect())
    expected = sorted((len(i := library.encode_ordinary(t)), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == expected
    assert bpe.encode_documents(nothing, PATH).collect() == []
    back = bpe.decode(bpe.encode(odd, "text", PATH, ["doc_id", "text"]), "ids", PATH).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    with pytest.raises(ValueError):
        bpe.encode(odd, "text", PATH, ["n_tokens"])


def test_every_code_point(codec, library):
    """Classes of all code points as the library sees them: as letters, as numbers, and beside a space."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("{c}'s", " {c}{c}", "1{c}2"):
        for at in range(0, len(points), 50_000):
            texts = [form.format(c=chr(c)) for c in points[at:at + 50_000]]
            assert ids(codec, texts) == [library.encode_ordinary(t) for t in texts], form


def test_decode_beside_any_columns(spark):
    rows = spark.createDataFrame([("Some text é", "x", "y", "z")], "text STRING, decoded STRING, ids_to_decode STRING, __ids STRING")
    out = bpe.decode(bpe.encode(rows, "text", PATH, ["decoded", "ids_to_decode", "__ids"]), "ids", PATH).first()
    assert (bytes(out.decoded_).decode(), out.decoded, out.ids_to_decode, out["__ids"], out.piece_starts) == ("Some text é", "x", "y", "z", [0, 4, 9])
