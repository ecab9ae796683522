"""Golden values on the hand-made edge fixture (FIXTURES.md, section B)."""

from decimal import Decimal

import edge_fixture
import pytest

from stagewise.plans.queries import PLANS


@pytest.fixture(scope="module")
def t(spark):
    return edge_fixture.tables(spark, "base")


def one(t, name):
    return PLANS[name](t).collect()


def test_kpis(t):
    assert one(t, "download_count")[0].download_count == 5
    assert one(t, "signup_count")[0].signup_count == 4
    assert one(t, "ride_request_count")[0].ride_request_count == 5
    r = one(t, "requested_vs_completed")[0]
    assert (r.rides_requested, r.rides_completed) == (5, 3)
    r = one(t, "requested_and_unique_users")[0]
    assert (r.rides_requested, r.unique_users_requesting_ride) == (5, 4)
    assert one(t, "average_ride_time")[0].average_ride_time_us == 15 * 60 * 1_000_000
    assert one(t, "accepted_ride_count")[0].accepted_ride_count == 4
    r = one(t, "payments_collected")[0]
    assert (r.total_rides, r.total_payment_received) == (2, "$23.35")


def test_by_platform(t):
    assert {r.platform: r.ride_request_count for r in one(t, "ride_requests_by_platform")} == {"android": 1, "ios": 3}
    card = {r.platform: (r.completed_rides, r.total_payment_amount) for r in one(t, "platform_scorecard")}
    assert card == {
        "ios": (1, Decimal("15.25")),
        "android": (1, Decimal("20.50")),
        "web": (0, Decimal("0.00")),
        None: (0, Decimal("0.00")),
    }


def test_step_funnels(t):
    assert one(t, "signup_to_request_dropoff")[0].drop_off_percentage == "0.00%"
    q11 = one(t, "funnel_step_conversion")
    assert [r["count"] for r in q11] == [5, 4, 4, 3, 3]
    assert [r.conversion_rate for r in q11] == [None] + [Decimal(x) for x in ("80.00", "100.00", "75.00", "100.00")]
    q12 = one(t, "funnel_conversion_and_dropoff")
    assert [r.conversion_rate for r in q12] == [Decimal(x) for x in ("100.00", "80.00", "100.00", "75.00", "100.00")]
    assert [r.drop_off_percentage for r in q12] == ["%", "20.00%", "0.00%", "25.00%", "0.00%"]
    assert [r.conversion_rate for r in one(t, "pct_of_previous_long")] == ["%", "80.0%", "100.0%"]
    assert [r.conversion_rate for r in one(t, "pct_of_top_first_value")] == ["100.0%", "80.0%", "80.0%"]
    shares = [r.percentage_share for r in one(t, "step_share_of_total")]
    assert shares == [Decimal(x) for x in ("55.56", "44.44", "44.44", "33.33", "33.33")]


def test_age_and_hours(t):
    q15 = {r.age_range: tuple(r)[1:] for r in one(t, "age_funnel_counts")}
    assert q15 == {"18-24": (1, 1, 1, 1, 1), "25-34": (1, 1, 0, 0, 0), "GDPR data": (1, 1, 1, 0, 1)}
    assert [r.age_range for r in one(t, "age_funnel_counts")] == ["18-24", "25-34", "GDPR data"]
    assert {r.hour_of_day: r.request_count for r in one(t, "requests_by_hour")} == {7: 1, 9: 1, 15: 1, 19: 1, 20: 1}


def test_dashboard_funnels(t):
    q31 = one(t, "general_funnel")
    assert [(r.user_count, r.ride_count) for r in q31][2:] == [(3, 4), (3, 3), (2, 2), (1, 1), (1, 1)]
    assert [r.ride_count for r in q31][:2] == [None, None]
    q33 = one(t, "segmented_funnel_alt")
    done = [r for r in q33 if r.step == 4]
    assert (sum(r.users_count for r in done), sum(r.count_rides for r in done)) == (3, 3)
    rev = [r for r in q33 if r.step == 6]
    assert (sum(r.users_count for r in rev), sum(r.count_rides for r in rev)) == (2, 1)
