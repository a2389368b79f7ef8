"""Benchmark the headline queries.

Runs each headline query over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]`` and prints ONE JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.

Every query is forced to completion with the ``noop`` sink (full computation,
no collect to the driver). A warm-up query runs first so JVM start-up is not
charged to the first headline query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pl_ingest",
    "pl_portfolio",
    "pl_ts_corpus",
    "sc_training_prompt",
    "pl_ts_corpus_filter_split",
    "ag_corpus_counts",
    "pl_sentiment_corpus",
    "pl_volatility_news",
    "pl_analyze",
    "pl_backtest",
    "jn_asof_next_day",
    "pn_stats_string",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pricelab.plans.catalog import QUERIES
    from pricelab.session import local_session

    spark = local_session(cpus, app="pricelab-bench",
                          **{"spark.sql.shuffle.partitions": str(max(8, int(cpus) * 2))})
    names = [a for a in sys.argv[1:]] or HEADLINE

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("ag_distinct_tickers")  # warm-up
    times = {}
    for n in names:
        times[n] = round(run(n), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
