"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the table folder and BENCH_CPUS the number of local cores. Each
query is run once untimed (compilation, file listing) and then timed, writing to
the noop sink so that every row and column is computed.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from shopfloor.plans import catalog
from shopfloor.sources import staging

HEADLINE = [
    "spc_imr_limits",
    "spc_rules_nelson",
    "spc_xbar_r",
    "spc_p",
    "spc_u",
    "spc_capability_gated",
    "spc_normality",
    "risk_score",
    "risk_rank_rpn",
    "risk_pareto",
    "ingest_errors_risk",
    "ingest_duplicates",
    "rel_links",
    "plan_build",
    "gage_rr",
    "signals_audit",
    "signals_pareto",
    "yield_summary",
    "loop_end_to_end",
    "live_snapshot_xbar_r",
    "spc_rules_we",
    "spc_violation_summary",
    "spc_xbar_s",
    "spc_histogram",
    "risk_rank_ap",
    "risk_counters",
    "risk_heatmap",
    "export_sanitized",
    "action_effectiveness",
    "signals_missingness",
    "signals_imr",
    "feedback",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shopfloor-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        with staging.scope() as staged:
            catalog.REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        staged.release(spark)
        return took

    seconds = {}
    for name in HEADLINE:
        run(name)
        seconds[name] = round(run(name), 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
