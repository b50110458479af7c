import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cuewright.functions.cues import SEPARATORS
from cuewright.sinks import committed
from cuewright.sinks.files import with_output_path


def files_below(folder):
    return sorted(p.relative_to(folder).as_posix() for p in folder.rglob("*") if p.is_file())


def outputs(folder):
    return {p.name: p.read_text() for p in folder.rglob("*.srt")}


@pytest.fixture
def parts(spark, tmp_path):
    rows = [(f"in/f{i}.srt", "srt", part, f"{i}-{part}\n") for i in range(30) for part in range(i % 3 + 1)] + [("in/empty.srt", "srt", 0, ""), ("in/null.srt", "srt", 0, None)]
    return with_output_path(spark.createDataFrame(rows, "path STRING, format STRING, part INT, content STRING"), str(tmp_path / "out dir"), "")


def test_the_list_equals_the_files(spark, parts, tmp_path):
    folder = tmp_path / "out dir"
    for _ in range(2):  # a second job replaces the files
        listed = {r.out_path.rpartition("/")[2]: r.n_bytes for r in committed.write_committed(parts, str(folder)).collect()}
        got = outputs(folder)
        assert listed == {name: len(text) for name, text in got.items()} and len(got) == 32
    assert got["f2.srt"] == SEPARATORS["srt"].join(["2-0\n", "2-1\n", "2-2\n"])
    assert got["empty.srt"] == got["null.srt"] == ""
    assert not [f for f in files_below(folder) if f.startswith("_writing")]
    assert committed.write_committed(parts.limit(0), str(tmp_path / "none")).count() == 0


def test_a_job_that_dies_leaves_nothing(spark, parts, tmp_path):
    folder = tmp_path / "out dir"
    folder.mkdir()
    (folder / "f1.srt").write_text("before")
    dying = parts.withColumn("content", F.when(F.col("path") == "in/f17.srt", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(PySparkException):
        committed.write_committed(dying, str(folder))
    assert files_below(folder) == ["f1.srt"] and (folder / "f1.srt").read_text() == "before"
    assert [p.name for p in folder.iterdir()] == ["f1.srt"]


def batch(*rows):
    return pa.RecordBatch.from_pylist([dict(zip(("out_path", "format", "content"), r)) for r in rows])


def test_lost_attempts_and_a_publication_in_two_goes(spark, tmp_path):
    job = "j1"
    staging, manifest = (f"{tmp_path}/{kind}-{job}" for kind in ("_writing", "_manifest"))
    target = lambda name: f"file://{tmp_path}/{name}.srt"
    writer = committed.file_sink()({"staging": staging, "manifest": manifest}).writer(None, False)

    def dies():
        yield batch((target("a"), "srt", "x"))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    assert files_below(tmp_path) == []
    lost = writer.write(iter([batch((target("a"), "srt", "of an attempt that is not counted"))]))
    counted = writer.write(iter([batch((target("a"), "srt", "x"), (target("b"), "srt", "y"))]))
    with pytest.raises(ValueError):
        committed.publish(spark, str(tmp_path), job)
    writer.commit([counted, None])
    # the first go ended after one file
    (tmp_path / f"_writing-{job}" / counted.attempt / "1").rename(tmp_path / "a.srt")
    listed = committed.publish(spark, str(tmp_path), job)
    assert {(r.out_path, r.n_bytes) for r in listed.collect()} == {(target("a"), 1), (target("b"), 1)}
    assert outputs(tmp_path) == {"a.srt": "x", "b.srt": "y"}
    assert not [f for f in files_below(tmp_path) if lost.attempt in f or "_writing" in f]
    assert committed.publish(spark, str(tmp_path), job).count() == 2


def test_an_output_of_several_inputs_is_an_error(spark, parts, tmp_path):
    with pytest.raises(ValueError):
        committed.write_committed(parts.withColumn("out_path", F.lit("/o/same")), str(tmp_path / "o"))


@pytest.mark.parametrize("task", [committed.file_sink, committed._mover])
def test_task_functions_need_no_package_on_the_workers(task):
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = "import sys, pickle; pickle.loads(sys.stdin.buffer.read())"
    done = subprocess.run([sys.executable, "-I", "-c", code], input=cloudpickle.dumps(task()), capture_output=True, cwd="/")
    assert done.returncode == 0, done.stderr.decode()[-500:]
