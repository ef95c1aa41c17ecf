"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names instead of the headline list
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = [
    "project_user_trades", "user_trades_dedup", "gamma_markets_latest", "asof_join_latest", "trade_enrich", "trade_enrich_v3", "minute_bars",
    "minute_lag_join", "position_ledger", "position_summary", "complete_sets_summary", "complete_set_pairs", "timing_quantiles", "market_churn",
    "execution_report", "smart_money_score", "index_build", "consensus_signals", "order_lifecycle_summary", "onchain_pair",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    from tradelens import catalog
    from tradelens.session import build_session

    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(int(cpus) * 2), spark__driver__memory="16g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    queries = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
