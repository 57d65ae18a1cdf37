"""Benchmark: run the headline queries and print one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set).
Each query is fully materialised with the ``noop`` sink (no collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recolake.plans.catalog import load_all  # noqa: E402
from recolake.session import build_session  # noqa: E402

HEADLINE = [
    "hybrid_recommendations", "cf_recommendations", "similar_items", "search_and_recommend",
    "rate_limit_admission", "category_sessions", "user_history", "encoded_ratings",
    "rating_stats", "trending_products", "trailing_request_counts", "regex_search", "als_fit_metrics",
    "stream_item_views", "stream_category_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), app_name="recolake-bench")
    reg = load_all()
    # warm-up of one-time per-executor costs (JVM/codegen, parquet footers, the reused
    # Python workers of the Arrow kernels); on a cluster these are paid once per executor
    reg["rating_distribution"].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    (spark.range(0, 64, 1, cpus).mapInPandas(lambda it: it, "id long")
     .write.format("noop").mode("overwrite").save())
    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        reg[n].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
