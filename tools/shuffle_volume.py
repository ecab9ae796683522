"""Shuffle volume of the rewritten queries against their naive SQL form.

Runs each query (DataFrame rewrite) and the reference-shaped SQL over the
same stored tables with Spark's event log enabled in a fresh scratch folder,
then sums, per form, the records and bytes written to shuffles and the rows
read from files. Latency at small scale is dominated by fixed overhead; the
shuffle volume is what grows with the data.

    python tools/shuffle_volume.py [--no-broadcast] [--days=N] [sf_dir] [query ...]

``--days`` adds the dashboard funnel of the first N download days in both forms,
with a Bloom filter of the reached users at the ride scan and without.

``--no-broadcast`` turns broadcast joins off, so every join is a shuffle
join, as it would be when both sides are large.
"""

from __future__ import annotations

import datetime
import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stagewise.plans.oracle import Q, build  # noqa: E402
from stagewise.plans.queries import PLANS, dashboard_rows  # noqa: E402
from stagewise.session import build_session  # noqa: E402
from stagewise.sources import materialize_tables  # noqa: E402
from stagewise.sources.days import downloaded  # noqa: E402

DEFAULT = ["age_funnel_counts", "general_funnel", "segmented_funnel", "segmented_funnel_alt"]


def main() -> None:
    args = sys.argv[1:]
    no_broadcast = "--no-broadcast" in args
    days = next((int(a.removeprefix("--days=")) for a in args if a.startswith("--days=")), 0)
    args = [a for a in args if not a.startswith("--")]
    sf_dir = args[0] if args else "/root/testdata/sf0.1"
    names = args[1:] or DEFAULT
    extra = (
        {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
        if no_broadcast
        else {}
    )
    evdir = tempfile.mkdtemp(prefix="stagewise-events-")
    spark = build_session(
        "local[8]",
        shuffle_partitions=8,
        extra_conf={
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": evdir,
            "spark.eventLog.compress": "false",
            "spark.eventLog.rolling.enabled": "false",
            **extra,
        },
    )
    tables, _ = materialize_tables(spark, sf_dir)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    sc = spark.sparkContext
    for name in names:
        for form, make in (("rewrite", lambda: PLANS[name](tables)), ("naive", lambda: spark.sql(build(Q[name], None)))):
            sc.setJobGroup(f"{name}|{form}", form)
            make().write.format("noop").mode("overwrite").save()
    if days:
        # The first days of downloads only: rides of other users leave at the scan, or after the shuffle.
        for key, value in (("applicationSideScanSizeThreshold", "0"), ("creationSideThreshold", "1g")):
            spark.conf.set(f"spark.sql.optimizer.runtime.bloomFilter.{key}", value)
        first = tables.app_downloads.selectExpr("min(to_date(download_ts))").first()[0]
        few = downloaded(tables, first, first + datetime.timedelta(days=days - 1))
        for form in ("written members", "shared join"):
            sc.setJobGroup(f"first {days} days|{form}", form)
            dashboard_rows(few, shared=form == "shared join").write.format("noop").mode("overwrite").save()
    spark.stop()

    path = [p for p in glob.glob(f"{evdir}/**", recursive=True) if os.path.isfile(p)][0]
    stage_group: dict[int, str] = {}
    totals: dict[str, dict[str, int]] = {}
    with open(path) as fh:
        for line in fh:
            e = json.loads(line)
            kind = e["Event"]
            if kind == "SparkListenerJobStart":
                group = e.get("Properties", {}).get("spark.jobGroup.id")
                if group:
                    for s in e["Stage IDs"]:
                        stage_group[s] = group
            elif kind == "SparkListenerTaskEnd" and e["Stage ID"] in stage_group:
                m = e.get("Task Metrics") or {}
                t = totals.setdefault(stage_group[e["Stage ID"]], {"shuffle_records": 0, "shuffle_bytes": 0, "input_rows": 0})
                w = m.get("Shuffle Write Metrics", {})
                t["shuffle_records"] += w.get("Shuffle Records Written", 0)
                t["shuffle_bytes"] += w.get("Shuffle Bytes Written", 0)
                t["input_rows"] += m.get("Input Metrics", {}).get("Records Read", 0)
    out = {}
    for group, t in sorted(totals.items()):
        name, form = group.split("|")
        out.setdefault(name, {})[form] = t
    print(json.dumps({"sf": os.path.basename(sf_dir.rstrip("/")), "broadcast": not no_broadcast, "queries": out}))


if __name__ == "__main__":
    main()
