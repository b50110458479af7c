"""The exact split goes through its input once."""

from pyspark.sql import functions as F

from cuewright.operators.dataset import stratified_split


def test_exact_split_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        seen.add(1)
        return f"text number {i}"

    rows = spark.range(900).select(text("id").alias("clean_text"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    split = stratified_split(rows, 0.25, exact=True)
    found = {r.label: (r.n, r.t) for r in split.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert found == {0: (600, 150), 1: (300, 75)} and seen.value == 900
