"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "adjusted_bars": "G07_adjusted_bars",
    "formula_batch": "O04_alpha191_082_101",
    "factor_score": "V05_factor_score",
    "ema": "ta_ema",
    "cs_rank": "X01_cs_rank",
    "correlation": "W12_correlation",
    "position_ledger": "L07_position_ledger",
    "daily_nav": "L10_daily_nav",
    "risk_ratios": "R06_risk_ratios",
    "candles": "ta_candles_1bar",
}


def main() -> None:
    from tessera.plans import QUERIES
    from tessera.session import local_session

    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for label, name in HEADLINE.items():
        times = []
        for i in range(runs + 1):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - start)
        seconds[label] = round(statistics.median(times), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
