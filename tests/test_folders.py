"""Folders of many small files, listed and read by tasks."""

import pytest
from pyspark.sql import functions as F

from cuewright.sources import corpus, folders
from cuewright.streaming import landing

CUE = "1\n00:00:01,000 --> 00:00:02,000\nhello\n"
ODD = ["a.txt", "b c.txt", "1+1.txt", "50%41.txt", "ز.txt", "#x.txt", "[d].txt"]


def spark_reader(spark, folder):
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select("value", F.col("_metadata.file_path").alias("file"))
    return corpus.merge_texts(raw.select(F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B"))).alias("path"), "value"))


def test_text_corpus_is_that_of_the_reader(spark, tmp_path):
    for i, name in enumerate(ODD):
        (tmp_path / name).write_bytes(f"<i>text</i> {i}\r\nend".encode())
    for name in ("_h.txt", ".h.txt", "a.srt"):
        (tmp_path / name).write_text("no")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "bom.txt").write_bytes(b"\xef\xbb\xbfx")
    (tmp_path / "in.txt").mkdir()
    (tmp_path / "in.txt" / "b.txt").write_text("below")
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        found = sorted(map(tuple, corpus.read_text_corpus(spark, folder).collect()))
        assert found == sorted(map(tuple, spark_reader(spark, folder).collect())) and len(found) == len(ODD) + 1


def test_the_driver_lists_no_text_file(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
    df = corpus.read_text_corpus(spark, str(tmp_path))
    assert not any(name.endswith(".txt") for name in df.inputFiles())
    assert {r.text for r in df.collect()} == {f"text {i}" for i in range(30)}


def test_patterns_and_missing_folders_go_to_the_reader(spark, tmp_path):
    (tmp_path / "x1").mkdir()
    (tmp_path / "x1" / "a.txt").write_text("one")
    assert [r.text for r in corpus.read_text_corpus(spark, f"{tmp_path}/x*").collect()] == ["one"]
    assert folders.files_of(spark, f"{tmp_path}/none") is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.read_text_corpus(spark, f"{tmp_path}/none")


@pytest.fixture
def reader(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "GROUP", 4)
    (tmp_path / "in").mkdir()
    options = {"folder": f"file://{tmp_path}/in", "log": f"file://{tmp_path}/log", "pattern": folders.name_pattern(spark, "*.{srt,SRT}"), "tasks": "2"}
    return lambda: folders.stream_source()(options).streamReader(None)


def names_of(source, start, end):
    parts = source.partitions({"files": start}, {"files": end})
    return sorted(path.rsplit("/", 1)[1] for p in parts for b in source.read(p) for path in b.column("path").to_pylist()), parts


def test_lists_of_a_stream(reader, tmp_path):
    """Numbers of files stay the same, whoever lists; a name is seen once."""
    put = lambda *ids: [(tmp_path / "in" / f"{i}.srt").write_text(f"c{i}") for i in ids]
    first = reader()
    assert first.latestOffset() == first.initialOffset() == {"files": 0}
    put(*range(11))
    (tmp_path / "in" / "a.vtt").write_text("x")
    (tmp_path / "in" / "empty.srt").write_text("")
    assert first.latestOffset() == {"files": 11} == first.latestOffset()
    for k in range(11, 31):  # more lists than are held apart
        put(k)
        assert first.latestOffset() == {"files": k + 1}
    (tmp_path / "in" / "empty.srt").write_text("now")
    again = reader()
    assert again.latestOffset() == {"files": 32} == first.latestOffset()
    whole, parts = names_of(again, 0, 32)
    assert whole == sorted([*(f"{i}.srt" for i in range(31)), "empty.srt"]) and all(p.high - p.low <= 4 for p in parts)
    assert sorted(names_of(again, 0, 7)[0] + names_of(again, 7, 13)[0] + names_of(again, 13, 32)[0]) == whole
    assert names_of(again, 11, 12)[0] == ["11.srt"] and names_of(again, 31, 32)[0] == ["empty.srt"]
    (tmp_path / "in" / "3.srt").write_text("changed")
    assert reader().latestOffset() == {"files": 32}


def test_two_streams_of_one_log(reader, tmp_path, monkeypatch):
    """The one that comes second lists again."""
    import os

    (tmp_path / "in" / "a.srt").write_text("x")
    one, two, link = reader(), reader(), os.link
    monkeypatch.setattr(os, "link", lambda *a: monkeypatch.setattr(os, "link", link) or two.latestOffset() and link(*a))
    assert one.latestOffset() == {"files": 1} and names_of(one, 0, 1)[0] == ["a.srt"]


def test_a_stream_names_no_files_on_the_driver(spark, tmp_path):
    """Restarts go on behind what was seen; offsets and commits hold numbers."""
    (tmp_path / "in").mkdir()
    put = lambda ids: [(tmp_path / "in" / f"{i}.srt").write_text(CUE) for i in ids]
    run = lambda out: landing.clean_stream(landing.landing_files(spark, f"{tmp_path}/in", "*.srt"), f"{tmp_path}/{out}", f"{tmp_path}/state-{out}").awaitTermination()
    for k in range(3):
        put(range(50 * k, 50 * k + 50))
        run("out")
    run("other")
    for out in ("out", "other"):
        got = spark.read.parquet(f"{tmp_path}/{out}").collect()
        assert sorted(r.path for r in got) == sorted(f"file:{tmp_path}/in/{i}.srt" for i in range(150)) and {r.content for r in got} == {CUE}
        written = [p for kind in ("offsets", "sources") for p in (tmp_path / f"state-{out}").glob(f"{kind}/**/*") if p.is_file()]
        assert written and not any(b".srt" in p.read_bytes() for p in written)


def test_source_needs_no_package_on_the_workers():
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = "import sys, pickle; pickle.loads(sys.stdin.buffer.read())"
    for made in (folders.stream_source(), folders._lister("file:///x", None), folders._reader("file:///x")):
        done = subprocess.run([sys.executable, "-I", "-c", code], input=cloudpickle.dumps(made), capture_output=True, cwd="/")
        assert done.returncode == 0, done.stderr.decode()[-500:]
