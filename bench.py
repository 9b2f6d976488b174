"""One JSON line: seconds of the pipeline's stages and of the registered queries.

BENCH_SF_DIR   folder of the warehouse tables (default sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_COPIES   every user this many times over, as different users, in the pipeline
               run (default 1; 81 at sf0.1 is about 21.5 million transactions),
               measured once after a warm-up on the plain tables
BENCH_QUERIES  comma-separated query names, or "none" (default: the headline list)
BENCH_PARTITIONS  shuffle partitions (default 8; a partition should hold a few hundred
               thousand rows, so 32 for 81 copies)
BENCH_DIR      folder for the raw files and outputs (default a local temporary one; a
               cluster needs one that its executors share)
BENCH_RUNS     measured runs after one warm-up; the median counts (default 2)

The pipeline reads raw CSV files written beforehand, untimed, and writes every table.
Queries go to a noop sink, so that every column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from lapsewise.config import WAREHOUSE
from lapsewise.plans.catalogue import REGISTRY
from lapsewise.plans.marts import warehouse_marts
from lapsewise.plans.pipeline import run_pipeline
from lapsewise.session import local_session
from lapsewise.sources import read_raw_members, read_raw_transactions
from lapsewise.sources.export import write_raw

HEADLINE = [
    "staged_transactions", "reconciliation_raw_staged", "check_duplicates_raw",
    "numbered_transactions", "spells_by_plan", "revenue_by_plan", "reactivation_term",
    "km_event_table", "km_summary_by_plan", "km_summary_by_cohort", "rmst_by_plan",
    "crossing_check", "exclusion_bracket", "channel_sensitivity", "ltv_report",
    "clock_sensitivity", "backtest_metrics", "truncation_quartiles", "audit_window",
    "audit_censoring", "audit_resubscribers", "audit_tx_per_user", "censoring_walk",
    "excluded_profile", "zero_day_profile",
]


def run_once(spark: SparkSession, raw: str) -> dict[str, float]:
    out = tempfile.mkdtemp(prefix="bench-out-", dir=os.environ.get("BENCH_DIR"))
    began = time.perf_counter()
    run = run_pipeline(
        spark,
        read_raw_transactions(spark, f"{raw}/transactions"),
        read_raw_members(spark, f"{raw}/members"),
        out,
        WAREHOUSE,
    )
    return {**run.seconds, "end_to_end": round(time.perf_counter() - began, 3)}


def timed(work) -> float:
    began = time.perf_counter()
    work()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    copies = int(os.environ.get("BENCH_COPIES", "1"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE))
    names = [] if wanted == "none" else wanted.split(",")
    partitions = os.environ.get("BENCH_PARTITIONS", "8")
    spark = local_session(cpus, "16g", **{"spark.sql.shuffle.partitions": partitions})

    small = tempfile.mkdtemp(prefix="bench-warm-", dir=os.environ.get("BENCH_DIR"))
    write_raw(spark, sf_dir, small, 4 * spark.sparkContext.defaultParallelism)
    run_once(spark, small)
    raw = small
    if copies > 1:
        raw = tempfile.mkdtemp(prefix="bench-raw-", dir=os.environ.get("BENCH_DIR"))
        write_raw(spark, sf_dir, raw, 4 * spark.sparkContext.defaultParallelism, copies)
    rows = read_raw_transactions(spark, f"{raw}/transactions").count()
    stages = [run_once(spark, raw) for _ in range(runs if copies == 1 else 1)]
    queries = {
        f"stage_{s}" if s != "end_to_end" else s: round(statistics.median(r[s] for r in stages), 3)
        for s in stages[0]
    }

    if names:
        queries["warehouse_marts"] = round(
            timed(lambda: [(m.users, m.subjects) for m in [warehouse_marts(spark, sf_dir, WAREHOUSE)]]), 3
        )
    for name in names:
        def go(query=REGISTRY[name]):
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()

        go()
        queries[name] = round(statistics.median(timed(go) for _ in range(runs)), 3)

    print(
        json.dumps(
            {
                "metric": "end_to_end_seconds",
                "value": queries["end_to_end"],
                "unit": "sec",
                "queries": queries,
                "sf": os.path.basename(sf_dir),
                "cpus": cpus,
                "transactions": rows,
                "rows_per_second": round(rows / queries["end_to_end"]),
            }
        )
    )
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
