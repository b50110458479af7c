"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from catalog import spark_queries
from cuewright.session import build_session

HEADLINE = [
    "doc_ads", "normalize_lines", "detect_planted", "srt_parse", "srt_roundtrip", "clean_srt_files", "rebuild_parts",
    "remove_ads", "replace_fixed", "ad_report", "batch_stats", "build_dataset", "extract_links", "extract_downloads",
    "archive_members", "char_ngram_counts", "tfidf_weights", "classification_report", "roc_auc", "recall_threshold",
    "train_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        # the tables are files of one row group, which one task would read
        "spark.cuewright.inputPartitions": cpus,
    })
    spark.sparkContext.setLogLevel("ERROR")
    # start the executors' threads and compile the scan before timing
    spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.length("text"))).collect()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        spark_queries.Q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
