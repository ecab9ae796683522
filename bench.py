"""Benchmark: warm median of every registered query.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The five funnel tables are derived from the driver's tables once and written
to a fresh folder under ``spark.checkpoint.dir`` (a local scratch folder
only when the setting is unset; the time is reported as ``derive_sec``).
Each query then runs against those Parquet tables, once to warm up and
``BENCH_REPS`` (default 5) times timed, executing the whole plan through the
``noop`` sink (no collect to the driver). The naive, reference-shaped SQL of
the rewritten queries (R1: age funnel, R2: dashboard funnels) is timed the
same way under ``naive``. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stagewise.plans.oracle import Q as ORACLE_QUERIES  # noqa: E402
from stagewise.plans.oracle import build  # noqa: E402
from stagewise.plans.queries import PLANS  # noqa: E402
from stagewise.session import build_session  # noqa: E402
from stagewise.sources import materialize_tables  # noqa: E402

# Reference-shaped statements that Spark SQL also parses (no DuckDB-only
# functions), compared against their rewrites.
NAIVE = ("age_funnel_counts", "general_funnel", "segmented_funnel", "segmented_funnel_alt")


def timed(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return time.perf_counter() - t0


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "5"))
    spark = build_session(
        f"local[{cpus}]",
        app_name="stagewise-bench",
        shuffle_partitions=cpus,
        extra_conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")},
    )
    t0 = time.perf_counter()
    tables, _ = materialize_tables(spark, sf_dir)
    derive_sec = time.perf_counter() - t0

    medians: dict[str, float] = {}
    for name, plan in PLANS.items():
        run_noop(plan(tables))
        medians[name] = round(statistics.median(timed(lambda: run_noop(plan(tables))) for _ in range(reps)), 4)

    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    naive: dict[str, float] = {}
    for name in NAIVE:
        stmt = build(ORACLE_QUERIES[name], None)
        run_noop(spark.sql(stmt))
        naive[name] = round(statistics.median(timed(lambda: run_noop(spark.sql(stmt))) for _ in range(reps)), 4)

    total = round(sum(medians.values()), 4)
    print(
        json.dumps(
            {
                "metric": "sum_of_query_median_sec",
                "value": total,
                "unit": "sec",
                "queries": medians,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "reps": reps,
                "derive_sec": round(derive_sec, 3),
                "naive": naive,
                "rewrite": {n: medians[n] for n in NAIVE},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
