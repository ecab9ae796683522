"""Sums beyond 64 bits, cents, days without a zone, stored schemas, missing denominators and repeated keys."""

import datetime as dt

import duckdb
import pytest

from stagewise.plans.oracle import oracle_statements
from stagewise.plans.queries import PLANS
from stagewise.session import is_local
from stagewise.sources import SCHEMAS, FunnelTables, SchemaError, load_tables, materialize_tables, read_tables, write_tables
from stagewise.sources.derive import derive_tables

SF = "/root/testdata/sf0.001"
NAMES = tuple(SCHEMAS)


def tables(spark, **rows):
    return FunnelTables(**{n: spark.createDataFrame(rows.get(n, []), SCHEMAS[n]) for n in NAMES})


def oracle(t, name, folder):
    write_tables(t, str(folder))
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{folder}/{n}.parquet/*.parquet')")
    cur = con.execute(oracle_statements(None)[name])
    columns = [c[0] for c in cur.description]
    return columns, sorted(cur.fetchall(), key=str)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_ride_time_sum_passes_64_bits(spark, tmp_path, ansi):
    start, end = dt.datetime(1, 1, 2), dt.datetime(9999, 1, 1)
    t = tables(spark, ride_requests=[(k, k, None, None, start, end, None) for k in range(60)])
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = PLANS["average_ride_time"](t).first()[0]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)
    each = (end - start) // dt.timedelta(microseconds=1)
    assert 60 * each > 2**63 and got == each
    assert oracle(t, "average_ride_time", tmp_path)[1] == [(each,)]


def test_cents_are_rounded_once(spark, tmp_path):
    t = tables(
        spark,
        app_downloads=[("d", "ios", None)],
        signups=[(1, "d", None, "18-24")],
        ride_requests=[(k, 1, None, None, None, dt.datetime(2021, 1, 1), None) for k in range(1000)],
        transactions=[(k, 0.004, "Approved") for k in range(1000)],
    )
    assert PLANS["payments_collected"](t).first()["total_payment_received"] == "$4.00"
    assert str(PLANS["platform_scorecard"](t).first()["total_payment_amount"]) == "4.00"
    for name in ("payments_collected", "platform_scorecard"):
        columns, want = oracle(t, name, tmp_path / name)
        assert sorted(map(tuple, PLANS[name](t).select(*columns).collect()), key=str) == want


def test_days_do_not_depend_on_the_zone(spark):
    t = tables(spark, app_downloads=[("d", "ios", dt.datetime(2017, 10, 15, 10))])
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        days = set()
        for zone in ("UTC", "America/Sao_Paulo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            days.add(PLANS["segmented_funnel"](t).selectExpr("CAST(download_date AS STRING) AS d").first()["d"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert days == {"2017-10-15 00:00:00"}


def test_stored_schema_is_checked(spark, tmp_path):
    write_tables(derive_tables(spark, SF), str(tmp_path / "a"))
    spark.read.parquet(str(tmp_path / "a/ride_requests.parquet")).drop("dropoff_ts").write.parquet(str(tmp_path / "b/ride_requests.parquet"))
    with pytest.raises(FileNotFoundError, match="app_downloads"):
        load_tables(spark, str(tmp_path / "b"))
    for n in NAMES:
        if n != "ride_requests":
            spark.read.parquet(str(tmp_path / f"a/{n}.parquet")).write.parquet(str(tmp_path / f"b/{n}.parquet"))
    with pytest.raises(SchemaError, match="ride_requests: column dropoff_ts is missing"):
        load_tables(spark, str(tmp_path / "b"))
    spark.read.parquet(str(tmp_path / "a/reviews.parquet")).selectExpr("CAST(ride_id AS STRING) ride_id", "user_id", "1 AS more").write.parquet(str(tmp_path / "c/reviews.parquet"))
    with pytest.raises(FileNotFoundError):
        read_tables(spark, str(tmp_path / "c"))
    for n in NAMES:
        if n != "reviews":
            spark.read.parquet(str(tmp_path / f"a/{n}.parquet")).write.parquet(str(tmp_path / f"c/{n}.parquet"))
    with pytest.raises(SchemaError, match="reviews: column ride_id is string, not bigint"):
        load_tables(spark, str(tmp_path / "c"))


def test_no_folder_on_a_cluster(spark, monkeypatch):
    assert is_local("local") and is_local("local[4]") and not is_local("yarn") and not is_local("local-cluster[2,1,1024]")

    class Context:
        master = "yarn"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        from stagewise.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(Session())
    assert callable(materialize_tables)


def test_no_denominator_gives_null(spark):
    t = tables(spark)
    for name in ("signup_to_request_dropoff", "signup_request_pct", "signup_completed_pct", "pct_of_previous_wide"):
        assert set(PLANS[name](t).first()) == {None}
    for name in ("pct_of_top_first_value", "pct_of_top_from_signup"):
        assert {r["conversion_rate"] for r in PLANS[name](t).collect()} == {None}
    for name in ("pct_of_previous_long", "pct_of_previous_from_signup"):
        rates = [r["conversion_rate"] for r in PLANS[name](t).collect()]
        assert rates[0] == "%" and set(rates[1:]) == {"0%"}


FANNED = ("ride_requests_by_platform", "platform_scorecard", "age_funnel_counts", "age_funnel_conversion", "general_funnel", "segmented_funnel", "segmented_funnel_alt")


@pytest.mark.parametrize("name", FANNED)
def test_repeated_keys_do_not_multiply(spark, tmp_path, name):
    """1500 downloads and 1500 signups of one key: no join makes anywhere near their product."""
    day = dt.datetime(2021, 1, 1)
    t = tables(
        spark,
        app_downloads=[("d", "ios", day)] * 1500,
        signups=[(7, "d", day, "18-24")] * 1500,
        ride_requests=[(k, 7, day, day, day, day, None) for k in range(40)] + [(None, 7, day, None, None, None, day)] * 20,
        transactions=[(k, 1.5, "Approved") for k in range(30)],
        reviews=[(k, 7) for k in range(20)] * 50,
    )
    df = PLANS[name](t)
    columns, want = oracle(t, name, tmp_path)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == want
    rows = []

    def walk(node):
        name = node.nodeName()
        if "Join" in name:
            rows.append(node.metrics().apply("numOutputRows").value())
        if name.startswith("AdaptiveSparkPlan"):
            walk(node.executedPlan())
        elif name.endswith("QueryStage"):
            walk(node.plan())
        elif name != "ReusedExchange":
            for k in range(node.children().size()):
                walk(node.children().apply(k))

    df = PLANS[name](t)
    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= 2000
