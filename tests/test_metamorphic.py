
from decimal import Decimal

import edge_fixture
import pytest

from stagewise.plans.queries import PLANS
from stagewise.sources import derive_tables


@pytest.fixture(scope="module")
def t(spark):
    return derive_tables(spark, "/root/testdata/sf0.01")


def rows(t, name):
    return PLANS[name](t).collect()


def test_wide_equals_long(t):
    wide = rows(t, "pct_of_previous_wide")[0]
    long = {r.step: r.conversion_rate for r in rows(t, "pct_of_previous_long")}
    assert long["Sign_Ups"] == wide.conversion_rate_app_signup
    assert long["Ride_Requests"] == wide.conversion_rate_signup_ride


def test_running_max_equals_first_value_when_not_growing(t):
    assert rows(t, "pct_of_running_max") == rows(t, "pct_of_top_first_value")


def test_running_max_differs_from_first_value_when_growing(spark):
    g = edge_fixture.tables(spark, "growing")
    run_max = [r.conversion_rate for r in PLANS["pct_of_running_max"](g).collect()]
    first = [r.conversion_rate for r in PLANS["pct_of_top_first_value"](g).collect()]
    # downloads 5, signups 4, requesting users 8: 8/8 vs 8/5
    assert run_max == ["100.0%", "80.0%", "100.0%"]
    assert first == ["100.0%", "80.0%", "160.0%"]
    q12 = PLANS["funnel_conversion_and_dropoff"](g).collect()
    assert q12[2].conversion_rate == Decimal("100.00")
    assert q12[2].drop_off_percentage == "-100.00%"


def test_capped_equals_uncapped_from_step_two(t):
    plain = rows(t, "funnel_step_conversion")
    capped = rows(t, "funnel_conversion_and_dropoff")
    assert [r.conversion_rate for r in plain][1:] == [r.conversion_rate for r in capped][1:]
    assert [tuple(r) for r in rows(t, "funnel_lowest_conversion")] == [tuple(r)[:4] for r in capped]


def test_dropoff_plus_requested_is_100(t):
    drop = Decimal(rows(t, "signup_to_request_dropoff")[0].drop_off_percentage.rstrip("%"))
    kept = Decimal(rows(t, "signup_request_pct")[0].signup_ride_request_percentage_users.rstrip("%"))
    assert abs(drop + kept - 100) <= Decimal("0.05")


def test_segments_sum_to_hours(t):
    hours = sum(r.request_count for r in rows(t, "requests_by_hour"))
    segs = sum(r.total_request_count for r in rows(t, "requests_by_day_segment"))
    assert hours == segs == rows(t, "ride_request_count")[0].ride_request_count


def test_segmented_totals_bound_general(t):
    """Per-segment user counts add up to at least the global distinct count,
    with equality when every user sits in exactly one segment (true here)."""
    general = {r.funnel_step: r.user_count for r in rows(t, "general_funnel")}
    seg = {}
    for r in rows(t, "segmented_funnel"):
        seg[r.funnel_step] = seg.get(r.funnel_step, 0) + r.user_count
    for step in (1, 2, 3, 4):
        assert seg[step] == general[step]
