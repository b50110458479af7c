import pytest

EXTRA = ("key text_key fp block place spans email email_wide ids n_tokens label score mix_key mix_at lang_key kept rank slot gram "
         "__id __text bucket size component_id fold mark c0 number packet blocks digest signature n_words runs n terms times __ids").split()
LONG = "word and another word, 4012888888881881. " * 8_000


def documents(spark, rows, extra=True):
    """``(doc_id, text, lang, source)`` as a documents table, with columns whose names operators may use."""
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT" + ("".join(f", `{c}` STRING" for c in [*EXTRA, "a.b"]) if extra else "")
    tail = ["?"] * (len(EXTRA) + 1) if extra else []
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *tail) for r in rows], schema)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, columns with clashing names."""
    return documents(spark, [
        (0, "A first text of some words, mail a.b@c.org now.", "en", "s"), (1, None, None, None), (2, "", "en", "s"), (None, "no id here at all", "en", "t"),
        (4, "the same text twice", "en", "s"), (4, "the same text twice", "en", "s"), (5, "the same text twice", "de", "t"), (4, "the same id, other text", "en", None),
        (6, LONG, "en", "s"), (None, None, None, None), (8, "naïve 日本語 😀 text\r\n\t ", "ja", "t"), (9, "x", "en", "u"),
    ]).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])
