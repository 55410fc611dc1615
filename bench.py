"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the
input and the local master; BENCH_QUERIES limits the run to a comma list.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barloom.operators import serving  # noqa: E402
from barloom.plans.catalogue import load  # noqa: E402
from barloom.plans.source_queries import _published  # noqa: E402
from barloom.session import build_session  # noqa: E402

HEADLINE = [
    "factor_panel",
    "f_macd",
    "market_daily",
    "industry_daily",
    "factor_ic",
    "quality_report",
    "row_missing_filter",
    "merge_history",
    "bt_targets",
    "bt_execution_bars_sparse",
    "stock_metrics",
    "peer_percentiles",
    "eval_classification",
    "lexicon_sentiment",
]
# The reference's five named reads, over a published star.
READS = {
    "read_stock_catalog": lambda t, p: serving.stock_catalog(t, None, True, 300),
    "read_stock_latest_252": lambda t, p: serving.bench_latest(t, p["code"], 252),
    "read_stock_three_years": lambda t, p: serving.bench_range(t, p["code"], "1998-11-04", "2001-11-04"),
    "read_market_snapshot": lambda t, p: serving.market_snapshot(t, None, 300),
    "read_industry_trend": lambda t, p: serving.industry_trend(t, p["industry"], "1998-11-04", "2001-11-04"),
}


def run(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue = load()
    times: dict[str, float] = {}
    # One small read first, so that the first query does not pay for the JVM's start.
    run(catalogue["panel_counts"].run(spark, sf_dir))
    for name in wanted or HEADLINE:
        if name in READS:
            continue
        # Planning and eager steps inside a query belong to its time.
        start = time.perf_counter()
        run(catalogue[name].run(spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    if not wanted or any(q in READS for q in wanted):
        start = time.perf_counter()
        tables = _published(spark, sf_dir)
        times["publish_star"] = round(time.perf_counter() - start, 3)
        first = tables["dim_stock"].where("has_detail = 1").orderBy("code").first()
        params = {"code": first["code"], "industry": first["industry_l1"]}
        for name, read in READS.items():
            run(read(tables, params))
            times[name] = round(sorted(run(read(tables, params)) for _ in range(3))[1], 4)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
