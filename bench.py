"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query runs to the end: its rows are
written to the ``noop`` sink. Each is timed once after a warm-up of the session.

``queries`` are timed on the tables as given. Their ``documents`` is one row group, which a single task reads, so queries
bound by text use one core there. ``spread`` times those again over the same rows in as many files as there are cores;
it is not part of ``value``.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from opinara.queries import load_all
from opinara.queries.models import FIT_SECONDS
from opinara.queries.registry import QUERIES
from opinara.session import BUILD_SETTINGS

HEADLINE = [
    "a00_final_table", "a03_dashboard_load", "c08_relevant_comments_b", "d02_comment_with_post", "e08_class_share_by_source",
    "e10_describe", "e14_correlation_matrix", "e18_monthly_shares", "e26_histogram", "e27_box_summary",
    "e32_word_frequencies", "f01_group_size", "f02_keep_first", "f05_comments_per_video", "i17_cleaning_profiles",
    "j01_polarity", "k04_tfidf", "k09_stratified_split", "l01_logistic_regression", "l02_random_forest",
    "l03_linear_svc", "m04_report", "m06_roc_auc", "n01_daily_counts",
]
#: Headline queries whose time goes into reading texts.
TEXT_BOUND = [
    "a03_dashboard_load", "c08_relevant_comments_b", "e27_box_summary", "e32_word_frequencies", "i17_cleaning_profiles",
    "j01_polarity", "k04_tfidf",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("opinara-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config(map=BUILD_SETTINGS).config("spark.sql.files.minPartitionNum", cpus).config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("lang").count().collect()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spread = {}
    with tempfile.TemporaryDirectory(prefix="opinara-bench-") as folder:
        for file in os.listdir(sf_dir):
            if file != "documents.parquet":
                os.symlink(os.path.join(os.path.abspath(sf_dir), file), os.path.join(folder, file))
        spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(int(cpus)).write.parquet(f"{folder}/documents.parquet")
        for name in TEXT_BOUND:
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spread[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "spread": spread, "fit_seconds": FIT_SECONDS, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
