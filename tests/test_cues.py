import random

import pytest
from pyspark.sql import functions as F

from cuewright.functions import cues as C
from cuewright.sources import corpus

A = "00:00:01,000 --> 00:00:02,000"
B = "00:00:03.500 --> 00:00:04.000"
V = "00:00:01.000 --> 00:00:02.000"

SRT = {
    "ok": (f"1\n{A}\nhello\n\n2\n{B}\nvisit us\nat www.a.com\n", [(0, "1", "hello"), (1, "2", "visit us\nat www.a.com")]),
    "bom": (f"\uFEFF1\n{A}\nlost\n\n2\n{A}\nkept\n", [(0, "2", "kept")]),
    "blank in cue": (f"1\n{A}\nhead\n\ntail\n\n2\n{A}\nnext\n", [(0, "1", "head"), (1, "2", "next")]),
    "no text": (f"1\n{A}\n\n2\n{A}\nx\n", [(0, "2", "x")]),
    "bad index": (f"A1\n{A}\nx\n", []),
    "long hours": ("1\n100:00:01,000 --> 100:00:02,000\nx\n", []),
    "long hours at start": ("1\n100:00:01,000 --> 00:00:02,000\nx\n", [(0, "1", "x")]),
    "persian digits": ("۱\n۰۰:۰۰:۰۱,۰۰۰ --> ۰۰:۰۰:۰۲,۰۰۰\nx\n", [(0, "۱", "x")]),
    "nel in text": (f"1\n{A}\na\x85b\n", [(0, "1", "a\nb")]),
    "blanks with spaces": (f"1\n{A}\nx\n \t\n\n2\n{A}\ny\n", [(0, "1", "x"), (1, "2", "y")]),
    "superscript index": (f"²\n{A}\nx\n", [(0, "²", "x")]),
    "empty": ("", []),
}

VTT = {
    "ok": (f"WEBVTT\n\n1\n{V}\nhi\n\n{V} align:start\nno id\n", [(0, "1", "hi"), (1, "", "no id")]),
    "text id": (f"WEBVTT\n\nintro\n{V}\nx\n", [(0, "", "x")]),
    "no hours": ("WEBVTT\n\n00:01.000 --> 00:02.000\nx\n", []),
    "space after header": (f"WEBVTT\n \n1\n{V}\nlost\n\n2\n{V}\nkept\n", [(0, "2", "kept")]),
    "empty text": (f"WEBVTT\n\n1\n{V}\n", [(0, "1", "")]),
    "note": (f"WEBVTT\n\nNOTE hi\n\n{V}\nx\n", [(0, "", "x")]),
    "header twice": (f"WEBVTT\n\n{V}\nx\n\nWEBVTT again\n{V}\nlost\n\n{V}\ny\n", [(0, "", "x"), (1, "", "y")]),
}


def table(spark, texts, suffix):
    rows = [(f"{name}{suffix}", content) for name, content in texts.items()]
    return corpus.files_from_table(spark.createDataFrame(rows, "path STRING, content STRING"))


@pytest.mark.parametrize("cases, suffix", [(SRT, ".srt"), (VTT, ".vtt")])
def test_literals(spark, cases, suffix):
    cues = corpus.explode_cues(corpus.parse(table(spark, {k: v[0] for k, v in cases.items()}, suffix))).collect()
    for name, (_, expected) in cases.items():
        assert sorted((r.pos, r.cue_index, r.text) for r in cues if r.path == name + suffix) == expected, name


def test_ass(spark):
    content = ("\uFEFF[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
               "Dialogue: 0,0:00:01.50,0:00:02.00,Default,,0,0,0,,{\\an8}visit us\\Nnow, ok\n"
               "  Comment: 0,1:00:00.05,1:00:01.00,Default,,0,0,0,,a\\hb\\nc  \nStyle: x\nDialogue: 0,bad")
    rows = corpus.explode_cues(corpus.parse(table(spark, {"x": content}, ".SSA"))).orderBy("pos").collect()
    assert [(r.pos, r.cue_index, r.start, r.end, r.text) for r in rows] == [
        (0, "1", "1500", "2000", "visit us\nnow, ok"), (1, "2", "3600050", "3601000", "a b\nc"), (2, "3", "0", "0", ""),
    ]
    assert rows[0].raw.startswith("Dialogue: 0,0:00:01.50")


def clock(rng, marks):
    return f"{rng.randint(0, 99):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}{rng.choice(marks)}{rng.randint(0, 999):03d}"


def made_files(seed, block, bad_blocks, n=800):
    """Files put together from known cues: ``(content, expected cues)``. Blocks that are no cue stand between them."""
    rng = random.Random(seed)
    words = ["a", "é", "1", "x y", "<i>t</i>", "-->", "دانلود", "9:", "{b}"]
    files = []
    for _ in range(n):
        blocks, expected = [], []
        for _ in range(rng.randint(0, 8)):
            if rng.random() < 0.3:
                blocks.append(rng.choice(bad_blocks))
            else:
                lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))]
                content, cue = block(rng, lines)
                blocks.append(content)
                expected.append(cue)
        gap = lambda: rng.choice(["\n\n", "\n\n\n", "\n \t\n", "\n\x0b\n"])
        text = "".join(b + gap() for b in blocks)
        files.append((text, expected))
    return files


def check_made(spark, files, parser):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(files)], "i INT, c STRING").select("i", parser(F.col("c")).alias("cues"))
    got = {r.i: [(c.cue_index, c.start, c.end, c.text) for c in r.cues] for r in df.collect()}
    wrong = [(c, e, got[i]) for i, (c, e) in enumerate(files) if got[i] != e]
    assert not wrong, ascii(wrong[:2])


def test_srt_from_known_cues(spark):
    def block(rng, lines):
        index, start, end = rng.choice(["1", "23", "²", "۴"]), clock(rng, ",."), clock(rng, ",.")
        return f"{index}\n{start}{rng.choice([' ', '', chr(9)])}-->{rng.choice([' ', '  '])}{end}\n" + "\n".join(lines), (index, start, end, "\n".join(lines))
    bad = [f"A1\n{A}\nx", f"1\n{A}", "1\nno time\nx", f"{A}\nx\ny", "alone", "1\n0:00:01,000 --> 00:00:02,000\nx", "1\n00:00:01,00 --> 00:00:02,000\nx"]
    check_made(spark, made_files(5, block, bad), C.srt_cues)


def test_vtt_from_known_cues(spark):
    def block(rng, lines):
        index, start, end = rng.choice(["1", "23", "²", "", "intro"]), clock(rng, "."), clock(rng, ".")
        lines = [line for line in lines if "-->" not in line] or ["t"]
        head = f"{index}\n" if index else ""
        settings = rng.choice(["", " align:start", " line:0 position:20%"])
        return f"{head}{start} --> {end}{settings}\n" + "\n".join(lines), ("" if index == "intro" else index, start, end, "\n".join(lines))
    bad = ["NOTE some words", "alone", "1\n00:01.000 --> 00:02.000\nx", f"1\n{A}\nx", "STYLE\n::cue { color: red }"]
    files = [("WEBVTT - a title\n\n" + text, cues) for text, cues in made_files(6, block, bad)]
    check_made(spark, files, C.vtt_cues)


def test_ssa_events_are_written_from_their_fields(spark):
    content = ("[Events]\nFormat: Marked, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
               "Dialogue: Marked=0,0:00:01.50,0:00:02.00,Default,,0000,0010,0000,,{\\b1}a, b\nComment: 3, 1:02:03.456,1:02:04.00,Sign,Bob,1,2,3,fx,c\nDialogue: 0,bad\n")
    batch = corpus.parse(table(spark, {"x": content}, ".ssa"))
    text = batch.select(C.render(F.col("format"), F.col("cues")).alias("t")).first().t
    assert text.split("Effect, Text\n")[1] == (
        "Dialogue: 0,0:00:01.50,0:00:02.00,Default,,0,10,0,,{\\b1}a, b\nComment: 3,1:02:03.45,1:02:04.00,Sign,Bob,1,2,3,fx,c\n"
        "Dialogue: 0,0:00:00.00,0:00:00.00,Default,,0,0,0,,\n")
    changed = batch.select(F.transform("cues", lambda c: C.with_text(c, F.lit("new\nline"))).alias("cues"))
    assert ",0,10,0,,new\\Nline\n" in changed.select(C.render(F.lit("ass"), F.col("cues")).alias("t")).first().t


def test_index_digits_are_those_of_python(apply):
    import unicodedata

    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.ucd_3_2_0.category(chr(c)) != "Cn"]
    got = apply(lambda c: c.rlike(C.INDEX_LINE), chars)
    assert [c for c, g in zip(chars, got) if g != c.isdigit()] == []


def test_times(apply):
    assert apply(C.time_ms, ["01:02:03,004", "00:00:01.500", "۰۰:۰۰:۰۱,۰۰۰", "1500", "x"]) == [3723004, 1500, 1000, 1500, None]


def test_format_by_suffix(apply):
    assert apply(C.file_format, ["a.SRT", "b.Vtt", "c.ass", "d.SSA", "e.txt", "x.vtt/none", "noext"]) == \
        ["srt", "vtt", "ass", "ass", "srt", "srt", "srt"]


def test_round_trip_is_exact(spark):
    srt, vtt = SRT["ok"][0], f"WEBVTT\n\n1\n{V}\nhi\nthere\n\n{V}\nno id\n"
    files = table(spark, {"a": srt}, ".srt").union(table(spark, {"b": vtt}, ".vtt"))
    batch = corpus.parse(files)
    got = {r.path: r.c for r in batch.select("path", C.render(F.col("format"), F.col("cues")).alias("c")).collect()}
    assert got == {"a.srt": srt, "b.vtt": vtt}


def test_decode(spark):
    bad = [b"\xff\xfea", b"a\xc3", b"\xe2\x82", b"\xed\xa0\x80x", b"ok\r\nx\ry", b"\xf0\x9f\x98"]
    df = spark.createDataFrame([(f"{i}.srt", bytearray(b)) for i, b in enumerate(bad)], "path STRING, content BINARY")
    got = [r.content for r in corpus.decode_files(df).orderBy("path").collect()]
    assert got == [b.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for b in bad]
    bom = spark.createDataFrame([("a.srt", bytearray("\uFEFF1".encode()))], "path STRING, content BINARY")
    assert corpus.decode_files(bom, strip_bom=True).first().content == "1"


def test_parsing_is_done_once(spark):
    """No second copy of the parser in a filter below the generator."""
    plan = corpus.explode_cues(corpus.parse(table(spark, {"a": "x"}, ".srt")))._jdf.queryExecution().optimizedPlan().toString()
    assert "size(CASE" not in plan
