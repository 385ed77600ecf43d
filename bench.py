"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.session import build_session  # noqa: E402
from catalog.queries import QUERIES  # noqa: E402

HEADLINES = {
    "j1_factor_frame": "factor_full_frame",
    "j2_training_panel": "panel_b02_training_set",
    "j3_event_features": "events_b03_w47_filing_features",
    "j4_propagation": "prop_l01_panel_features",
    "j5_ic_by_year": "eval_ic_by_year",
    "j5_decile_profile": "eval_a07_decile_profile",
    "j6_backtest": "backtest_b01_metrics",
    "j7_signal_report": "signal_b05_a13_report",
    "j8_price_alerts": "stream_st1_price_alerts",
    "tech_score": "tech_w40_score",
    "rank_normalise": "xs_x01_rank_centered",
    "asof_fundamentals": "asof_j04_fundamentals",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "20g")})
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:]
    times = {}
    for label, name in HEADLINES.items():
        if wanted and label not in wanted:
            continue
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[label] = round(time.time() - start, 3)
        print(f"{label} {times[label]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
