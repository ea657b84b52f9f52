"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  table folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_SHARED_DIR  folder for intermediate tables (default: a new temporary folder)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from lograin.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "cluster_key",
    "log_stats",
    "file_stats",
    "interval_report",
    "daily_report",
    "console_report",
    "report_payload",
    "json_shape_counts",
    "json_nodes",
    "severity_windows",
    "severity_alerts",
    "overall_alerts",
    "alerts",
    "stream_log_stats",
]


def spread(spark: SparkSession, sf_dir: str, files: int) -> str:
    """Lay the tables that the queries read out in as many files as cores, as data at scale are.

    A table here is one file with one row group, which a single task would read.
    """
    out = f"{spark.conf.get('spark.checkpoint.dir')}/{os.path.basename(sf_dir.rstrip('/'))}"
    for name in ("events", "documents", "pages", "conversations"):
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        table.repartition(files).write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    return out


def main() -> None:
    given = sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lograin-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="lograin-bench-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")

    # session start-up is not part of any query
    spark.range(10**6).selectExpr("sum(id)").collect()

    sf_dir = spread(spark, sf_dir, int(cpus))
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(given.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
