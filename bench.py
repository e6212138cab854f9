"""Times the headline queries, warm, and prints one line of JSON.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads, BENCH_QUERIES (comma
separated) other queries than the headline ones.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from tidemark import queries as engine
from tidemark.session import session
from tidemark.sources import fixtures

HEADLINE = (
    "bars_daily", "bars_resample_3", "coverage_by_ticker", "asof_origin", "sma_20", "wma_20", "ema_20", "rolling_ols", "logtrend_ratio", "bar_rank_features", "regime_trend_oscillator",
    "forward_extremes", "zigzag_pivots", "zigzag_leg_stats", "pool_vectors", "band_forecast", "weighted_quantiles_wide", "plain_quantiles_wide", "density_heatmap", "stft_power",
    "knn_l2", "range_forecast_zones", "corridor_pool", "corridor_bounds", "upsert_latest", "retention_keep_n", "liquidity_rank", "position_sizing",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tidemark-bench-"),
    })
    spark.sparkContext.setLogLevel("OFF")
    queries, took, built = engine.queries(), {}, {}
    if names is HEADLINE:
        begin = time.perf_counter()
        for make in (fixtures.raw, fixtures.walk, fixtures.orders, fixtures.hourly):  # the bar tables, which are written at their first use
            make(spark, sf)
        built["build_bars"] = round(time.perf_counter() - begin, 3)  # with the warming up of the JVM
    for name in names:
        best = None
        for _ in range(2):  # the first run warms up
            begin = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - begin)
        took[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")} | built))


if __name__ == "__main__":
    main()
