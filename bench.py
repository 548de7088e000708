"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pitline.catalog import load_all, tables
from pitline.catalog.registry import QUERIES
from pitline.session import local_session

HEADLINES = [
    "trailing_returns",
    "volatility",
    "drawdown",
    "price_as_of_announcement",
    "event_session_dates",
    "event_abnormal_return",
    "event_rollup",
    "classify_documents",
    "filings_to_events",
    "pit_fundamentals",
    "prior_event_stats",
    "model_table",
    "target_profile",
    "ks_drift",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    QUERIES["trading_calendar"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up, not measured
    seconds = {}
    for stage_name, build in (("stage_market", tables.labelled), ("stage_model", tables.model)):
        start = time.perf_counter()
        build(spark, sf_dir)
        seconds[stage_name] = round(time.perf_counter() - start, 3)
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
