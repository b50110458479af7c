import io
import zipfile

import pytest
from pyspark.sql import functions as F

from cuewright.sources import archives, corpus, places
from cuewright.sources.archives import _lister, _member_reader

A = "00:00:01,000 --> 00:00:02,000"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def split(spark):
    """Many small row groups and splits."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_first_rows_are_read_by_address(spark, tmp_path, split):
    rows = spark.range(5000).select((F.col("id") % 700).alias("key"), F.col("id").alias("value"), F.repeat(F.lit("x"), F.col("id").cast("int") % 50).alias("text"))
    rows = rows.withColumn("key", F.when(F.col("key") != 3, F.col("key")))
    folder = str(tmp_path / "a table")
    rows.coalesce(2).write.option("parquet.block.size", 8192).parquet(folder)
    table = spark.read.parquet(folder)
    got = {r.key: (r.value, r.text) for r in places.first_rows(table, "key").collect()}
    at = {}
    listed = table.select("*", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).collect()
    for r in sorted(listed, key=lambda r: (r.f, r.i)):
        at.setdefault(r.key, (r.value, r.text))
    assert got == at and None in got and len(got) == 700


def test_no_shuffle_carries_contents(spark, tmp_path, split):
    content = f"1\n{A}\nhello\n"
    rows = [(f"f{i % 60}.srt", "srt", content + "\n" * i) for i in range(200)] + [(None, "srt", content), ("none.srt", "srt", None)]
    spark.createDataFrame(rows, "path STRING, format STRING, content STRING").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    first = plan_of(places.first_places(table, "path"))
    assert "content#" not in first and "ReadSchema: struct<path:string,_tmp_metadata_row_index:bigint>" in first
    batch = corpus.load_batch_table(table)
    below = plan_of(batch).split("MapInArrow")[1]  # what feeds the reader: addresses only
    assert "Exchange rangepartitioning" in below and "ReadSchema: struct<file:string,row:bigint>" in below
    assert "Exchange" not in plan_of(batch).split("MapInArrow")[0]
    got = {r.path: None if r.cues is None else [c.text for c in r.cues] for r in batch.collect()}
    assert got == {**{f"f{i}.srt": ["hello"] for i in range(60)}, None: ["hello"], "none.srt": None}
    assert batch.count() == 62
    empty = spark.read.schema(table.schema).parquet(str(tmp_path / "t")).limit(0)
    empty.write.parquet(str(tmp_path / "empty"))
    assert corpus.load_batch_table(spark.read.parquet(str(tmp_path / "empty"))).count() == 0


def test_tasks_follow_the_bytes_of_the_contents(spark, split):
    assert places.tasks_for(spark.range(1), 0) == spark.sparkContext.defaultParallelism
    assert places.tasks_for(spark.range(1), 100 << 14) == 100


def zip_of(*members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in members:
            z.writestr(name, content)
    return data.getvalue()


def write(root, **files):
    (root / "Farsi").mkdir(parents=True, exist_ok=True)
    for name, content in files.items():
        (root / "Farsi" / f"{name}.zip").write_bytes(content)


def one_by_one(root):
    """Archives unpacked in turn; a name that is there is passed over, a failure ends the archive."""
    kept, bad = {}, []
    for path in sorted(root.rglob("*.zip")):
        try:
            with zipfile.ZipFile(path) as z:
                for entry in z.infolist():
                    name = entry.filename.rpartition("/")[2]
                    if name and not entry.is_dir() and name not in kept:
                        kept[name] = z.read(entry)
        except Exception:
            bad.append(path.name)
    return kept, bad


def extracted(spark, root):
    members, errors = archives.extract_first(archives.list_members(spark, str(root)))
    rows = members.collect()
    kept = {r.name: bytes(r.content) for r in rows}
    assert len(kept) == len(rows)
    return kept, sorted(r.archive.rpartition("/")[2] for r in errors.collect())


def test_first_members_by_the_directories(spark, tmp_path):
    write(tmp_path / "in dir", a=zip_of(("x/", ""), ("x/one", "first"), ("y/one", "second"), ("two", "")), b=zip_of(("one", "late"), ("three", "3")), c=b"no zip", d=zip_of())
    (tmp_path / "in dir" / "english").mkdir()
    (tmp_path / "in dir" / "english" / "e.zip").write_bytes(zip_of(("four", "4")))
    assert extracted(spark, tmp_path / "in dir" / "Farsi") == one_by_one(tmp_path / "in dir" / "Farsi") == ({"one": b"first", "two": b"", "three": b"3"}, ["c.zip"])
    assert extracted(spark, tmp_path / "in dir")[0].keys() == {"one", "two", "three"}


def test_a_broken_member_ends_its_archive(spark, tmp_path):
    broken = lambda name: (name, f"broken {name}")
    spoil = lambda data: data.replace(b"broken", b"spoilt")  # the check sums stay
    write(
        tmp_path,
        a=spoil(zip_of(("one", "a1"), broken("two"), ("three", "a3"))),  # ends at two; three comes of a later one
        b=spoil(zip_of(broken("one"), broken("two"), ("four", "b4"))),  # one is passed over unread; ends at two in the second round; four is lost again
        c=zip_of(("two", "c2"), ("three", "c3")),
        d=spoil(zip_of(broken("three"), ("four", "d4"), ("two", "d2"))),  # three is passed over
    )
    expected = one_by_one(tmp_path)
    assert expected == ({"one": b"a1", "two": b"c2", "three": b"c3", "four": b"d4"}, ["a.zip", "b.zip"])
    assert extracted(spark, tmp_path) == expected


def test_losers_are_not_unpacked(spark, tmp_path):
    spoilt = zip_of(("one", "broken one")).replace(b"broken", b"spoilt")
    write(tmp_path, a=zip_of(("one", "1")), b=spoilt)  # would be an error if it were read
    assert extracted(spark, tmp_path) == ({"one": b"1"}, [])
    listed = plan_of(archives.list_members(spark, str(tmp_path)))
    assert "content#" not in listed


def test_an_empty_folder_of_archives(spark, tmp_path):
    (tmp_path / "Farsi").mkdir()
    (tmp_path / "Farsi" / "a.txt").write_text("x")
    assert extracted(spark, tmp_path) == ({}, [])


@pytest.mark.parametrize("task", [_lister, _member_reader, places.opener])
def test_task_functions_need_no_package_on_the_workers(task):
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = "import sys, pickle; pickle.loads(sys.stdin.buffer.read())"
    done = subprocess.run([sys.executable, "-I", "-c", code], input=cloudpickle.dumps(task()), capture_output=True, cwd="/")
    assert done.returncode == 0, done.stderr.decode()[-500:]


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    """More files than tasks, where the reader alone would give each a task of its own."""
    most = 64 * spark.sparkContext.defaultParallelism
    for i in range(most + 20):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as zipped:
            zipped.writestr(f"{i}.txt", "x")
    before = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for n in before:
        spark.conf.set(n, "64k")
    try:
        folder = str(tmp_path)
        for read in (corpus.read_corpus(spark, folder, "*.txt"), corpus.read_text_corpus(spark, folder), archives.list_members(spark, folder, tmp_path.name),
                     archives.read_archives(spark, folder, tmp_path.name)):
            assert read.rdd.getNumPartitions() <= most and read.count() == most + 20
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
