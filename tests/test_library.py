"""The operators as a library: custom specs and segments against brute force.

Brute force here is pandas over the sf0.001 tables (a few hundred rows),
following the naive definitions: join, filter, count distinct.
"""

from decimal import Decimal

import pandas as pd
import pytest

from stagewise.functions import day_start_sql
from stagewise.operators import SegmentStep, segmented_funnel, spec, stage_counts, step_rates
from stagewise.sources import derive_tables


@pytest.fixture(scope="module")
def t(spark):
    return derive_tables(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def pdf(t):
    return {name: df.toPandas() for name, df in t.items()}


def test_custom_stage_counts(t, pdf):
    my_spec = spec(
        ("Sign_Ups", "signups", "user_id"),
        ("Accepted", "ride_requests", "user_id", "accept_ts IS NOT NULL"),
        ("Open", "ride_requests", "ride_id", "cancel_ts IS NULL AND dropoff_ts IS NULL"),
        ("Reviewed_Rides", "reviews", "ride_id"),
    )
    got = {r.step: r["count"] for r in stage_counts(t, my_spec).collect()}
    rr = pdf["ride_requests"]
    want = {
        "Sign_Ups": pdf["signups"].user_id.nunique(),
        "Accepted": rr[rr.accept_ts.notna()].user_id.nunique(),
        "Open": rr[rr.cancel_ts.isna() & rr.dropoff_ts.isna()].ride_id.nunique(),
        "Reviewed_Rides": pdf["reviews"].ride_id.dropna().nunique(),
    }
    assert got == want


def test_step_rate_modes_on_growing_counts(spark):
    counts = spark.createDataFrame(
        [("a", 1, 5), ("b", 2, 4), ("c", 3, 8), ("d", 4, 0), ("e", 5, 3)], "step string, step_order int, count bigint"
    )
    prev = [r.conversion_rate for r in step_rates(counts, "previous", scale=1).orderBy("step_order").collect()]
    first = [r.conversion_rate for r in step_rates(counts, "first", scale=1).orderBy("step_order").collect()]
    runmax = [r.conversion_rate for r in step_rates(counts, "running_max", scale=1).orderBy("step_order").collect()]
    capped = [r.conversion_rate for r in step_rates(counts, "previous", scale=2, cap=100).orderBy("step_order").collect()]
    d = Decimal
    assert prev == [None, d("80.0"), d("200.0"), d("0.0"), d("0")]  # base 0 -> the zero rule
    assert first == [d("100.0"), d("80.0"), d("160.0"), d("0.0"), d("60.0")]
    assert runmax == [d("100.0"), d("80.0"), d("100.0"), d("0.0"), d("37.5")]
    assert capped == [d("100.00"), d("80.00"), d("100.00"), d("0.00"), d("0.00")]


def _brute_force_by_platform(pdf) -> dict[tuple[int, str], tuple[int, int]]:
    ad, sg, rr, tx, rv = (pdf[n] for n in ("app_downloads", "signups", "ride_requests", "transactions", "reviews"))
    base = ad.merge(sg, left_on="app_download_key", right_on="session_id", how="left")
    out = {}
    for p, g in base.groupby("platform", dropna=False):
        out[(1, p)] = (g.app_download_key.nunique(), 0)
        out[(2, p)] = (g.user_id.dropna().nunique(), 0)
    users = base[base.user_id.notna()][["platform", "user_id"]]
    rides = rr.merge(users, on="user_id")
    paid = tx[tx.charge_status == "Approved"][["ride_id"]].drop_duplicates()
    reviewed = rv[rv.ride_id.notna()][["ride_id"]].drop_duplicates()
    flags = {
        3: rides.user_id.notna(),
        4: rides.accept_ts.notna(),
        5: rides.dropoff_ts.notna(),
        6: rides.ride_id.isin(paid.ride_id),
        7: rides.ride_id.isin(reviewed.ride_id),
    }
    for step, mask in flags.items():
        for p, g in rides[mask].groupby("platform", dropna=False):
            out[(step, p)] = (g.user_id.nunique(), g.ride_id.nunique())
    return out


def test_segmented_funnel_custom_dims_against_brute_force(t, pdf):
    steps = [
        SegmentStep(1, "Downloads", "download"),
        SegmentStep(2, "Signups", "signup"),
        SegmentStep(3, "Ride_Requests", "ride", "user_id IS NOT NULL", rides=True),
        SegmentStep(4, "Ride_Accepted", "ride", "accept_ts IS NOT NULL", rides=True),
        SegmentStep(5, "Completed_Rides", "ride", "dropoff_ts IS NOT NULL", rides=True),
        SegmentStep(6, "Payment", "ride", "paid", rides=True),
        SegmentStep(7, "Reviews", "ride", "reviewed", rides=True),
    ]
    got = {(r.step, r.platform): (r.users, r.rides) for r in segmented_funnel(t, steps, [("platform", "platform")]).collect()}
    want = _brute_force_by_platform(pdf)
    assert {k: v for k, v in want.items() if k[0] > 2} == {k: v for k, v in got.items() if k[0] > 2}
    assert {k: v[0] for k, v in want.items() if k[0] <= 2} == {k: v[0] for k, v in got.items() if k[0] <= 2}


def test_segment_expressions_are_sql(t):
    """Any SQL expression over a download joined to its signup can segment."""
    dims = [("week", f"date_trunc('WEEK', {day_start_sql('download_ts')})"), ("has_age", "age_range IS NOT NULL")]
    out = segmented_funnel(t, [SegmentStep(1, "Downloads", "download")], dims)
    assert out.agg({"users": "sum"}).first()[0] == 150
    assert out.columns == ["step", "name", "week", "has_age", "users", "rides"]


def test_stage_duration_interval_matches_micros(spark):
    import datetime as dt

    from stagewise.operators import stage_duration

    rows = [(dt.datetime(2021, 1, 1, 8, 5), dt.datetime(2021, 1, 1, 8, 15)),
            (dt.datetime(2021, 1, 1, 19, 8), dt.datetime(2021, 1, 1, 19, 28)),
            (dt.datetime(2021, 1, 1, 20, 5), dt.datetime(2021, 1, 1, 20, 20, 0, 1)),
            (None, dt.datetime(2021, 1, 1, 9, 0))]
    df = spark.createDataFrame(rows, "pickup_ts timestamp_ntz, dropoff_ts timestamp_ntz")
    r = stage_duration(df, "pickup_ts", "dropoff_ts").first()
    assert r.rides == 3
    assert r.average_us == 900_000_000  # (600 + 1200 + 900.000001) s / 3, half up
    assert r.average == dt.timedelta(microseconds=r.average_us)


def test_oracle_ctes_do_not_hide_driver_tables():
    import re

    from compare import DRIVER_TABLES

    from stagewise.plans.oracle import ORACLE_SQL

    for name, sql in ORACLE_SQL.items():
        ctes = set(re.findall(r"(?:WITH|,)\s*\n?\s*([a-z_][a-z0-9_]*)\s+AS\s*\(", sql))
        assert ctes, name
        assert not ctes & set(DRIVER_TABLES), (name, ctes & set(DRIVER_TABLES))
