import io
import zipfile

import pytest
from pyspark.sql import functions as F

from cuewright.functions.cues import render
from cuewright.operators import actions, dataset, detect, render as out, stats
from cuewright.plans.clean import clean_files, flagged_cues, flagged_lines
from cuewright.schema import CUES
from cuewright.sinks import files as sink
from cuewright.sources import archives, corpus
from cuewright.streaming import landing

A = "00:00:01,000 --> 00:00:02,000"
V = "00:00:01.000 --> 00:00:02.000"
SRT = f"1\n{A}\nhello\n\n2\n{A}\nvisit us\nat www.a.com\n"
ASS = ("[Events]\nDialogue: 0,0:00:01.50,0:00:02.00,Default,,0,0,0,,{\\an8}plain, text\n"
       "Dialogue: 0,0:00:03.00,0:00:04.00,Default,,0,0,0,,{\\an8}join us, now")


@pytest.fixture
def files(spark):
    rows = [("/in/a.srt", SRT), ("/in/b.vtt", f"WEBVTT\n\n{V}\nclick the link\n"), ("/in/c.ass", ASS), ("/in/d.srt", "")]
    return corpus.files_from_table(spark.createDataFrame(rows, "path STRING, content STRING"))


@pytest.fixture
def cues(files):
    return corpus.explode_cues(corpus.parse(files))


def keys(df):
    return sorted((r.path, r.pos) for r in df.collect())


def test_schema(cues):
    assert cues.columns == CUES.names


def test_detect(files, cues):
    ads = [("/in/a.srt", 1), ("/in/b.vtt", 0), ("/in/c.ass", 1)]
    assert keys(detect.detect(cues)) == ads == keys(flagged_cues(files))
    assert keys(detect.detect(cues, ruleset="lite")) == []
    assert keys(detect.detect_rules(cues, ruleset=["hel+o"])) == [("/in/a.srt", 0)]
    marked = detect.mark_batch(corpus.parse(files))
    assert keys(corpus.explode_cues(marked).filter("is_ad")) == ads
    assert keys(detect.keyword_filter(cues, "HELLO")) == [("/in/a.srt", 0)]
    assert detect.keyword_filter(cues, "").count() == 5


def test_clean_files_each_action(files):
    def run(**kw):
        return {r.path: r.content for r in clean_files(files, **kw).collect()}
    removed = run(action="remove")
    assert removed["/in/a.srt"] == f"1\n{A}\nhello\n" and removed["/in/b.vtt"] == "WEBVTT\n" and removed["/in/d.srt"] == ""
    assert removed["/in/c.ass"].endswith("{\\an8}plain, text\n") and "join" not in removed["/in/c.ass"]
    replaced = run(action="replace", text="x\ny")
    assert replaced["/in/a.srt"] == f"1\n{A}\nhello\n\n2\n{A}\nx\ny\n"
    assert replaced["/in/c.ass"].endswith("0:00:03.00,0:00:04.00,Default,,0,0,0,,x\\Ny\n")
    drawn = run(action="replace_random", texts=["one", "two"])
    assert drawn["/in/b.vtt"] in (f"WEBVTT\n\n{V}\none\n", f"WEBVTT\n\n{V}\ntwo\n")
    assert drawn == run(action="replace_random", texts=["one", "two"])
    assert "Exchange" not in clean_files(files, "remove")._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        clean_files(files, "list")


def test_flat_and_nested_ways_agree(spark, files, cues):
    for action in ("remove", "replace", "replace_random"):
        kw = {"text": "-", "texts": ["p", "q", "r"], "seed": 3}
        flat = out.join_parts(out.rebuild(actions.clean(cues, action, **kw), files))
        nested = clean_files(files, action, **kw)
        assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, nested.select("path", "format", "content").collect()))


def test_actions_by_key(spark, cues):
    targets = spark.createDataFrame([("/in/a.srt", 0), ("/in/a.srt", 0), ("/in/c.ass", 1)], "path STRING, pos INT")
    assert keys(actions.remove_cues(cues, targets)) == [("/in/a.srt", 1), ("/in/b.vtt", 0), ("/in/c.ass", 0)]
    replaced = actions.replace_cues(cues, targets, "new")
    assert replaced.count() == 5 and keys(replaced.filter("text = 'new'")) == [("/in/a.srt", 0), ("/in/c.ass", 1)]
    assert replaced.filter("raw LIKE '%,new'").count() == 1
    drawn = actions.replace_random(cues, targets, ["p", "q"])
    assert keys(drawn.filter("text IN ('p', 'q')")) == [("/in/a.srt", 0), ("/in/c.ass", 1)]
    edits = spark.createDataFrame([("/in/a.srt", 0, "old", 1), ("/in/a.srt", 0, "late", 2), ("/in/a.srt", 1, None, 3)],
                                  "path STRING, pos INT, new_text STRING, seq INT")
    edited = {(r.path, r.pos): r.text for r in actions.apply_edits(cues, edits).collect()}
    assert edited["/in/a.srt", 0] == "late" and edited["/in/a.srt", 1] == "visit us\nat www.a.com" and len(edited) == 5
    assert keys(actions.only_decided(cues, targets)) == [("/in/a.srt", 0), ("/in/c.ass", 1)]


def test_choose_action():
    assert actions.choose_action() == "list"
    assert actions.choose_action(list_only=True, remove=True) == "list"
    assert actions.choose_action(remove=True, replace="x") == "remove"
    assert actions.choose_action(replace="", replace_random=["a"]) == "replace_random"
    assert actions.choose_action(replace="") == "list"


def test_rebuild_in_parts(spark):
    n = 25
    content = "\n\n".join(f"{i}\n{A}\nt{i}" for i in range(n)) + "\n"
    files = corpus.files_from_table(spark.createDataFrame([("a.srt", content), ("b.srt", "")], "path STRING, content STRING"))
    cues = corpus.srt_cue_table(files).filter("pos >= 8")  # the first part is empty
    parts = out.rebuild(cues, files, cues_per_part=4)
    assert parts.filter("path = 'a.srt'").count() == 6
    joined = {r.path: r.content for r in out.join_parts(parts).collect()}
    assert joined == {"a.srt": "\n".join(f"{i}\n{A}\nt{i}\n" for i in range(8, n)), "b.srt": ""}


def test_report_file(spark, cues, tmp_path):
    sink.write_report(out.ad_report(detect.detect(cues)), f"{tmp_path}/report")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/report").collect()]
    assert len(lines) == 3 * 3 + 1 + 2 * 3 and lines.count("--- File: b.vtt ---") == 1


def test_aggressive_mode_silences_link_rules(spark):
    rows = [("see http://x.io",), ("mail me@x.org",), ("@handle",), ("visit us",)]
    df = spark.createDataFrame(rows, "text STRING")
    assert detect.detect_rules(df).count() == 4
    assert [r.text for r in detect.detect_rules(df, aggressive=True).collect()] == ["visit us"]


def test_reports(spark, cues):
    flagged = detect.detect(cues)
    lines = [r.line for r in out.ad_report(flagged).filter("path = '/in/a.srt'").orderBy("path", "pos", "line_no").collect()]
    assert "\n".join(lines) + "\n" == f"--- File: a.srt ---\nIndex: 2 | Time: {A}\nText: visit us\nat www.a.com\n\n\n"
    console = out.ad_report(flagged, "console").filter("path = '/in/a.srt'").orderBy("pos", "line_no").collect()
    assert "\n".join(r.line for r in console) + "\n" == f"a.srt: block 2 [{A}]\n    visit us\nat www.a.com\n\n"


def test_stats(spark, files, cues):
    marked = detect.mark(cues)
    decided = spark.createDataFrame([("/in/a.srt", 1), ("/in/a.srt", 0)], "path STRING, pos INT")
    assert stats.batch_stats(marked, decided).first() == (3, 5, 3, 1)
    assert stats.batch_stats(marked).first() == (3, 5, 3, 3)
    assert stats.batch_totals(detect.mark_batch(corpus.parse(files))).first() == (4, 5, 3)
    assert corpus.batch_counts(corpus.load_batch(files.union(files))).first() == (4, 5)
    assert {r.path: r.dropped for r in corpus.dropped_chunks(files.filter("format = 'srt'")).collect()} == {"/in/a.srt": 0, "/in/d.srt": 0}


def test_flagged_lines(spark):
    docs = spark.createDataFrame([(1, "a\nvisit us\nwww.x"), (2, ""), (3, None)], "id INT, text STRING")
    assert sorted(tuple(r) for r in flagged_lines(docs, "id").collect())[:2] == [(1, 3, 2), (2, 1, 0)]


@pytest.mark.parametrize("path, expected", [
    ("/x/a.b.srt", "/x/a.b_clean.srt"), ("a", "a_clean"), ("/x/.srt", "/x/.srt_clean"), ("x/a.", "x/a._clean"), ("file:/d/e.VTT", "file:/d/e_clean.VTT"),
])
def test_output_path(apply, path, expected):
    assert apply(lambda c: sink.output_path(c), [path]) == [expected]


def test_files_written_and_read(spark, tmp_path):
    rows = [(f"/in/f{i}.srt", "\n\n".join(f"{j}\n{A}\nline {j}" for j in range(1 + i % 7)) + "\n") for i in range(40)]
    files = corpus.files_from_table(spark.createDataFrame(rows, "path STRING, content STRING"))
    parts = sink.with_output_path(out.rebuild(corpus.srt_cue_table(files), files, cues_per_part=2), f"file://{tmp_path}/out dir")
    written = sink.write_files(parts).collect()
    assert len(written) == 40
    back = {r.path.rsplit("/", 1)[1]: r.content for r in corpus.read_corpus(spark, f"{tmp_path}/out dir", "*.srt").collect()}
    assert back == {p[4:-4] + "_clean.srt": c for p, c in rows}
    assert not list((tmp_path / "out dir").glob("*.tmp"))
    clash = sink.with_output_path(files, "/o").withColumn("out_path", F.lit("/o/same"))
    with pytest.raises(ValueError):
        sink.write_files(clash)
    twice = corpus.read_corpus(spark, [f"{tmp_path}/out dir", f"{tmp_path}/out dir/f1_clean.srt"])
    assert twice.count() == 40


def test_missing_corpus_is_an_error(spark):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        corpus.read_corpus(spark, "/none/such")


def zip_of(*members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in members:
            z.writestr(name, content)
    return data.getvalue()


def test_archives(spark, tmp_path):
    for folder, name, content in [
        ("s1/Farsi", "b.zip", zip_of(("x/", ""), ("x/one.srt", "late"), ("two.srt", "2"))),
        ("s1/farsi", "a.ZIP", zip_of(("one.srt", "first"), ("y/one.srt", "second"))),
        ("s1/english", "c.zip", zip_of(("three.srt", "no"))),
        ("s2/farsi", "d.zip", b"not a zip"),
        ("s2/farsi", "e.txt", b"no archive"),
    ]:
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_bytes(content)
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a file per partition
    try:
        assert archives.read_archives(spark, str(tmp_path)).rdd.getNumPartitions() == 3  # not the one in "english"
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", "1m")
    members = archives.read_archives(spark, str(tmp_path))
    kept = {r.name: bytes(r.content) for r in archives.first_of_name(members).collect()}
    # "Farsi" sorts before "farsi"
    assert kept == {"one.srt": b"late", "two.srt": b"2"}
    assert [r.archive.rsplit("/", 1)[1] for r in archives.bad_archives(members).collect()] == ["d.zip"]


def test_text_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("{\\an8}<i>Hi</i>\r\nthere".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.srt").write_text("no")
    assert [r.text for r in corpus.read_text_corpus(spark, str(tmp_path)).collect()] == ["Hi there"]
    assert sorted(r.text for r in corpus.read_lines(spark, str(tmp_path / "a.txt")).collect()) == ["there", "{\\an8}<i>Hi</i>"]


def test_dataset(spark, tmp_path):
    lines = spark.createDataFrame([("كتاب خوب است و خوب",), ("کتاب خوب است و خوب",), ("short",), ('a "quoted, text"\nwith end',)], "text STRING")
    built = dataset.build_dataset(lines, 1)
    assert sorted(map(tuple, built.collect())) == [('a "quoted, text"\nwith end', 1), ("کتاب خوب است و خوب", 1)]
    for fmt in ("csv",):
        sink.write_dataset(built, f"{tmp_path}/d", fmt)
        assert sorted(map(tuple, corpus.read_dataset(spark, f"{tmp_path}/d").collect())) == sorted(map(tuple, built.collect()))
    both = dataset.union_datasets(built, built.withColumn("label", F.lit(0)))
    assert sorted(map(tuple, dataset.class_counts(both).collect())) == [(0, 2), (1, 2)]
    shuffled = [r.clean_text for r in dataset.shuffle(both).collect()]
    assert shuffled == [r.clean_text for r in dataset.shuffle(both).collect()] and len(shuffled) == 4


def test_stratified_split(spark):
    df = spark.range(5003).select(F.concat(F.lit("t"), "id").alias("clean_text"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    exact = dataset.stratified_split(df, exact=True)
    counts = {r.label: (r.n, r.t) for r in exact.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert counts == {1: (715, 143), 0: (4288, 858)}
    loose = dataset.stratified_split(df)
    share = loose.agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert 0.18 < share < 0.22
    assert sorted(loose.filter("is_test").collect()) == sorted(dataset.stratified_split(df.repartition(3)).filter("is_test").collect())


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text(SRT)
    run = lambda: landing.clean_stream(
        landing.landing_files(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    run()
    (tmp_path / "in" / "b.srt").write_text(SRT)
    run()  # only the new file
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == ["a.srt", "b.srt"]
    assert {r.content for r in got} == {f"1\n{A}\nhello\n"}
    landing.flag_stream(landing.landing_files(spark, f"{tmp_path}/in", "*.srt"), f"{tmp_path}/ads", f"{tmp_path}/state2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/ads").count() == 2


@pytest.mark.parametrize("task", [archives._unpacker, sink._writer])
def test_task_functions_need_no_package_on_the_workers(task):
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = "import sys, pickle; pickle.loads(sys.stdin.buffer.read())"
    done = subprocess.run([sys.executable, "-I", "-c", code], input=cloudpickle.dumps(task()), capture_output=True, cwd="/")
    assert done.returncode == 0, done.stderr.decode()[-500:]


def test_shared_folder_is_named_on_a_cluster(tmp_path):
    from types import SimpleNamespace

    from cuewright.session import shared_folder

    def session(master, folder=None):
        get = lambda key, default=None: folder if key == "spark.checkpoint.dir" else default
        return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=get)))
    with pytest.raises(ValueError):
        shared_folder(session("yarn"), "x")
    with pytest.raises(ValueError):
        shared_folder(session("local-cluster[3,2,1024]"), "x")
    assert shared_folder(session("local[4]"), "x")
    assert shared_folder(session("yarn", "hdfs:///shared"), "x").startswith("hdfs:///shared/x-")


def test_no_texts_to_choose_from(spark):
    files = corpus.files_from_table(spark.createDataFrame([("a.srt", f"1\n{A}\nx\n")], "path STRING, content STRING"))
    cues = corpus.srt_cue_table(files)
    with pytest.raises(ValueError):
        actions.replace_random(cues, cues, [])


def test_whole_files_are_written_without_a_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([("a.srt", "srt", "x"), ("b.srt", "srt", "")], "path STRING, format STRING, content STRING")
    written = sink.write_files(sink.with_output_path(rows, str(tmp_path / "o")))
    assert "Exchange" not in written._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.out_path.rsplit("/", 1)[1], r.n_bytes) for r in written.collect()) == [("a_clean.srt", 1), ("b_clean.srt", 0)]
    assert (tmp_path / "o" / "b_clean.srt").read_bytes() == b""


def test_a_file_without_cues_is_rebuilt(spark):
    files = corpus.files_from_table(spark.createDataFrame([("a.vtt", "WEBVTT\n"), ("b.srt", "none")], "path STRING, content STRING"))
    cues = corpus.explode_cues(corpus.parse(files))
    assert {r.path: r.content for r in out.join_parts(out.rebuild(cues, files)).collect()} == {"a.vtt": "WEBVTT\n", "b.srt": ""}


def test_first_of_name_compares_no_contents(spark):
    rows = spark.createDataFrame([("z1", 0, "n", bytearray(b"x"), None)], "archive STRING, ordinal INT, name STRING, content BINARY, error STRING")
    plan = archives.first_of_name(rows)._jdf.queryExecution().executedPlan().toString()
    combined = [line for line in plan.split("\n") if "Aggregate" in line]
    assert combined and not any("content" in line for line in combined)


def test_stream_of_small_files_has_its_own_settings(spark, tmp_path):
    """A batch is listed and read by few tasks, whatever the caller's settings, which stay as they are."""
    names = ("spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    own = landing.landing_files(spark, str(tmp_path)).sparkSession
    assert int(own.conf.get(names[0])) == landing.OPEN_COST and int(own.conf.get(names[1])) == 4 * spark.sparkContext.defaultParallelism
    assert own.conf.get(names[2]) == before[2] and [spark.conf.get(n) for n in names] == before


def test_written_files_are_reported_by_batches(tmp_path):
    """One frame for a batch of rows, not one for each file; a file may go on in the next batch."""
    import pandas as pd

    from cuewright.sinks.files import _writer

    frame = lambda ids: pd.DataFrame({"out_path": [f"{tmp_path}/a/{i}.srt" for i in ids], "format": "srt", "content": [f"c{i}" for i in ids]})
    frames = list(_writer()(iter([frame(range(5)), frame([4, 5]), frame([5]), frame([])])))
    assert len(frames) <= 3 and sorted(r.out_path for f in frames for r in f.itertuples()) == [f"{tmp_path}/a/{i}.srt" for i in range(6)]
    assert [(tmp_path / "a" / f"{i}.srt").read_text() for i in (0, 3)] == ["c0", "c3"] and (tmp_path / "a" / "5.srt").read_text().split() == ["c5", "c5"]
    assert {r.out_path[-5:]: r.n_bytes for f in frames for r in f.itertuples()}["0.srt"] == 2
