"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "revenue_model_comparison",
    "bucket_weekly",
    "gap_spine_daily",
    "interpolate_linear",
    "lag_block",
    "roll_median",
    "decompose_daily",
    "autocorrelation",
    "unit_root_augmented",
    "ar_order_choice",
    "baselines",
    "linear_models",
    "knn_forecast",
    "holt",
    "holt_winters",
    "arima_fixed_order",
    "harmonic",
    "additive",
    "selector",
    "metric_table",
    "random_forest",
    "boosted_trees",
    "support_vector",
    "knn_grid_search",
    "additive_grid_scores",
    "arima",
    "whole_run",
)


def main() -> None:
    from chronoloom.catalog.queries import QUERIES
    from chronoloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the session before timing
    chosen = sys.argv[1:] or HEADLINE
    seconds = {}
    QUERIES[chosen[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compile once before timing
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
