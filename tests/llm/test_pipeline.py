"""The stages one after another, and every query of the package."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline

DATA = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.queries() if n == "pipeline" or n.startswith("op"))


def test_names():
    assert {n.split("_")[0] for n in NAMES} == {"pipeline", *(f"op{i}" for i in range(1, 11))} and len(NAMES) == 11
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mix", "tokens"]


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        after = docs.count()
        assert after < before if name in ("quality", "near_duplicates") else after == before, name
        before = after


def test_place_in_the_mix_outlives_files(spark, tmp_path):
    """Written to several files and read in another order, the last stage still gives the order that the mix stage decided."""
    stages = dict(corpus_pipeline.STAGES)
    ordered = stages["mix"](spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    expected = [r.doc_id for r in ordered.select("doc_id").collect()]
    ordered.repartition(5).write.parquet(str(tmp_path / "docs"))
    rows = stages["tokens"](spark, spark.read.parquet(str(tmp_path / "docs")), DATA).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.mix_slot, r.mix_source, r.mix_place))] == expected


@pytest.mark.parametrize("name", NAMES)
def test_query_runs(spark, name):
    rows = entry.queries()[name](spark, DATA)
    assert rows.count() > 0
    assert len(set(rows.columns)) == len(rows.columns)


def test_no_import_guards_in_the_pipeline():
    source = open(os.path.join(os.path.dirname(entry.__file__), "corpus_pipeline.py")).read()
    assert "except" not in source
