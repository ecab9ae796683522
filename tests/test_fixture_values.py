"""Expected values published in FIXTURES.md for the driver data at sf0.01.

They were computed independently of this library (and of its oracle SQL).
"""

from decimal import Decimal

import pytest

from stagewise.plans.queries import PLANS
from stagewise.sources import derive_tables


@pytest.fixture(scope="module")
def t(spark):
    return derive_tables(spark, "/root/testdata/sf0.01")


def rows(t, name):
    return PLANS[name](t).collect()


def test_payments_and_duration(t):
    r = rows(t, "payments_collected")[0]
    assert (r.total_rides, r.total_payment_received) == (4161, "$1042890452.30")
    assert rows(t, "average_ride_time")[0].average_ride_time_us == (2 * 7000020000000 + 4654) // (2 * 4654)


def test_general_funnel_steps(t):
    got = [(r.user_count, r.ride_count) for r in rows(t, "general_funnel")][2:]
    assert got == [(900, 9029), (899, 8162), (767, 4577), (766, 4091), (507, 2052)]


def test_dashboard_row_counts_and_completed(t):
    assert PLANS["segmented_funnel"](t).count() == 6180
    alt = rows(t, "segmented_funnel_alt")
    assert len(alt) == 6254
    done = [r for r in alt if r.step == 4]
    assert (sum(r.users_count for r in done), sum(r.count_rides for r in done)) == (843, 4986)


def test_share_denominator(t):
    first = rows(t, "step_share_of_total")[0]
    assert (first["count"], first.percentage_share) == (1500, Decimal("62.11"))  # 1500 / 2415


def test_day_segments_and_age_funnel(t):
    seg = [(r.total_request_count, r.average_per_hour_ride) for r in rows(t, "requests_by_day_segment")]
    assert seg == [(1788, Decimal("223.50")), (2302, Decimal("1151.00")), (1397, Decimal("232.83")),
                   (2731, Decimal("682.75")), (948, Decimal("237.00"))]
    ages = {r.age_range: tuple(r)[1:] for r in rows(t, "age_funnel_counts")}
    assert ages == {
        "18-24": (186, 186, 154, 139, 94),
        "25-34": (154, 154, 115, 93, 50),
        "35-44": (178, 178, 150, 126, 82),
        "45-54": (190, 190, 147, 134, 87),
        "55-64": (152, 152, 121, 99, 66),
        "GDPR data": (130, 130, 105, 86, 68),
    }
