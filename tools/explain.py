"""Print the formatted physical plan of registered queries.

    python tools/explain.py [--no-broadcast] [sf_dir] query [query ...]

The plan is taken after running the query, so it is adaptive execution's
final plan (joins chosen at runtime, coalesced partitions, skew splits).
``--no-broadcast`` shows the plan shape for large inputs, where every join
is a shuffle join.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stagewise.plans.queries import PLANS  # noqa: E402
from stagewise.session import build_session  # noqa: E402
from stagewise.sources import load_tables  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    no_broadcast = "--no-broadcast" in args
    args = [a for a in args if a != "--no-broadcast"]
    sf_dir = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [a for a in args if "/" not in a] or ["segmented_funnel"]
    extra = (
        {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
        if no_broadcast
        else {}
    )
    spark = build_session("local[8]", shuffle_partitions=8, extra_conf=extra)
    tables = load_tables(spark, sf_dir)
    for name in names:
        df = PLANS[name](tables)
        df.collect()
        print(f"===== {name}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
