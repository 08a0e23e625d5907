"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then three times; the median is reported. Results
are consumed in full by Spark's no-op sink, so nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from seekloom.operators.bm25_index import write_index  # noqa: E402
from seekloom.workload import inputs  # noqa: E402
from seekloom.workload.registered import REGISTERED  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "bm25_postings",
    "bm25_df",
    "bm25_topk",
    "keyword_search",
    "vector_topk_all_pairs_of_ids",
    "vector_topk_approx",
    "hybrid_search",
    "rag_context",
    "upsert_wide",
    "bm25_df_incremental",
    "bm25_postings_incremental",
    "coverage_audit",
]


def consume(frame: DataFrame) -> None:
    """Compute every row and column."""
    frame.write.format("noop").mode("overwrite").save()


def median_seconds(run) -> float:
    """Median of the timed runs after one warm-up."""
    run()
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def main() -> None:
    """Run the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("seekloom-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="seekloom-bench-"))
        .config("spark.seekloom.scan.tasks", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    seconds["index_build"] = median_seconds(
        lambda: write_index(inputs.chunks(spark, SF_DIR), chunk_buckets=2, term_buckets=4)
    )
    for name in HEADLINE:
        seconds[name] = median_seconds(lambda name=name: consume(REGISTERED[name](spark, SF_DIR)))
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(CPUS),
                "spark": spark.version,
                "runs": RUNS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
