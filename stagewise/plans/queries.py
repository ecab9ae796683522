"""The reference's 33 questions as DataFrame plans over the funnel tables.

Each function takes :class:`FunnelTables` and returns a lazy DataFrame whose
``bigint``, rates ``decimal(18,2)`` / ``decimal(18,1)``, money
``decimal(38,2)``, hours ``int``; textual percentages as ``'<rate>%'``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import age_label_sql, age_sort_key_sql, quote
from ..functions.rates import as_text_sql, pct_sql, rate_or_null_sql
from ..functions.time import day_sql, day_start_sql
from ..operators.duration import stage_duration
from ..operators.hourly import bucket_hours, hourly_profile
from ..operators.segmented import SegmentStep, segmented_funnel
from ..operators.segments import APPROVED, MONEY, platform_scorecard, ride_requests_by_platform, segment_counts
from ..operators.share import shares_of_ids
from ..operators.spec import SIGNUP_FUNNEL, SIGNUP_TOP_FUNNEL, TOP_FUNNEL, USER_FUNNEL
from ..operators.stage_counts import stage_counts
from ..operators.step_rates import drop_off_text_sql, step_rates
from ..operators.user_flags import AGE_MEASURES, age_funnel_counts
from ..sources.tables import FunnelTables

COMPLETED = "dropoff_ts IS NOT NULL"


def _distinct(df: DataFrame, col: str, name: str, where: str | None = None) -> DataFrame:
    rows = df.where(where) if where is not None else df
    return rows.agg(F.expr(f"count(DISTINCT {col}) AS {name}"))


def _one_row(*frames: DataFrame) -> DataFrame:
    """Cross join of one-row global aggregates (each has exactly one row)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(F.broadcast(f))
    return out


# ---- single-number KPIs -------------------------------------------------

def download_count(t: FunnelTables) -> DataFrame:
    return _distinct(t.app_downloads, "app_download_key", "download_count")


def signup_count(t: FunnelTables) -> DataFrame:
    return _distinct(t.signups, "user_id", "signup_count")


def ride_request_count(t: FunnelTables) -> DataFrame:
    return t.ride_requests.agg(F.expr("count(*) AS ride_request_count"))


def requested_vs_completed(t: FunnelTables) -> DataFrame:
    return t.ride_requests.agg(
        F.expr("count(*) AS rides_requested"),
        F.expr(f"CAST(sum(CASE WHEN {COMPLETED} THEN 1 ELSE 0 END) AS BIGINT) AS rides_completed"),
    )


def requested_and_unique_users(t: FunnelTables) -> DataFrame:
    return t.ride_requests.agg(
        F.expr("count(*) AS rides_requested"),
        F.expr("count(DISTINCT user_id) AS unique_users_requesting_ride"),
    )


def average_ride_time(t: FunnelTables) -> DataFrame:
    """Mean pickup-to-dropoff time in whole microseconds."""
    return stage_duration(t.ride_requests, "pickup_ts", "dropoff_ts").selectExpr(
        "average_us AS average_ride_time_us"
    )


def accepted_ride_count(t: FunnelTables) -> DataFrame:
    return t.ride_requests.where("accept_ts IS NOT NULL").agg(F.expr("count(*) AS accepted_ride_count"))


def payments_collected(t: FunnelTables) -> DataFrame:
    approved = t.transactions.where(f"charge_status = {quote(APPROVED)}")
    agg = approved.agg(
        F.expr("count(DISTINCT ride_id) AS total_rides"),
        F.expr(f"CAST(sum({MONEY}) AS DECIMAL(38,2)) AS amount"),
    )
    return agg.selectExpr("total_rides", f"{as_text_sql('amount', suffix='', prefix='$')} AS total_payment_received")


def unique_requesting_users(t: FunnelTables) -> DataFrame:
    return _distinct(t.ride_requests, "user_id", "unique_users")


def unique_completing_users(t: FunnelTables) -> DataFrame:
    return _distinct(t.ride_requests, "user_id", "unique_users_completed", COMPLETED)


# ---- two-number ratios ---------------------------------------------------

def signup_to_request_dropoff(t: FunnelTables) -> DataFrame:
    s = _distinct(t.signups, "user_id", "s")
    r = _distinct(t.ride_requests, "user_id", "r")
    return _one_row(s, r).selectExpr(f"{rate_or_null_sql(pct_sql('s - r', 's', 2))} AS drop_off_percentage")


def signup_request_pct(t: FunnelTables) -> DataFrame:
    s = _distinct(t.signups, "user_id", "s")
    r = _distinct(t.ride_requests, "user_id", "r")
    return _one_row(s, r).selectExpr(f"{rate_or_null_sql(pct_sql('r', 's', 1))} AS signup_ride_request_percentage_users")


def signup_completed_pct(t: FunnelTables) -> DataFrame:
    s = _distinct(t.signups, "user_id", "s")
    c = _distinct(t.ride_requests, "user_id", "c", COMPLETED)
    return _one_row(s, c).selectExpr(f"{rate_or_null_sql(pct_sql('c', 's', 1))} AS signup_completed_percentage_users")


def pct_of_previous_wide(t: FunnelTables) -> DataFrame:
    d = _distinct(t.app_downloads, "app_download_key", "d")
    s = _distinct(t.signups, "user_id", "s")
    r = _distinct(t.ride_requests, "user_id", "r")
    return _one_row(d, s, r).selectExpr(
        f"{rate_or_null_sql(pct_sql('s', 'd', 1))} AS conversion_rate_app_signup",
        f"{rate_or_null_sql(pct_sql('r', 's', 1))} AS conversion_rate_signup_ride",
    )


# ---- step funnels ------------------------------------------------------

def _sorted_small(df: DataFrame, *keys) -> DataFrame:
    """Sort a result whose row count is bounded by construction (steps, hours,
    fixed segments): one task sorts it, with no range-partitioning pass."""
    return df.coalesce(1).sortWithinPartitions(*keys)


def _ordered(df: DataFrame, *cols: str) -> DataFrame:
    return df.orderBy("step_order").select(*cols)


def _listed(rates: DataFrame, stages) -> DataFrame:
    """Keep the listed steps, filtering *after* the rate window (the window
    needs every step's count; the filter must not move below it)."""
    names = ", ".join(quote(s.name) for s in stages)
    return rates.where(f"step IN ({names})")


def funnel_step_conversion(t: FunnelTables) -> DataFrame:
    rates = step_rates(stage_counts(t, USER_FUNNEL), "previous", scale=2)
    return _ordered(rates, "step", "count", "previous_count", "conversion_rate")


def funnel_conversion_and_dropoff(t: FunnelTables) -> DataFrame:
    rates = step_rates(stage_counts(t, USER_FUNNEL), "previous", scale=2, cap=100)
    rates = rates.selectExpr("*", f"{drop_off_text_sql('`count`', 'previous_count', 2)} AS drop_off_percentage")
    return _ordered(rates, "step", "count", "previous_count", "conversion_rate", "drop_off_percentage")


def funnel_lowest_conversion(t: FunnelTables) -> DataFrame:
    """Every step with its capped rate; the lowest one is read off the rows."""
    rates = step_rates(stage_counts(t, USER_FUNNEL), "previous", scale=2, cap=100)
    return _ordered(rates, "step", "count", "previous_count", "conversion_rate")


def pct_of_previous_long(t: FunnelTables) -> DataFrame:
    rates = step_rates(stage_counts(t, TOP_FUNNEL), "previous", scale=1, text=True)
    return _ordered(_listed(rates, TOP_FUNNEL), "step", "conversion_rate")


def pct_of_running_max(t: FunnelTables) -> DataFrame:
    rates = step_rates(stage_counts(t, TOP_FUNNEL), "running_max", scale=1, base_name="max_count", text=True)
    return _ordered(_listed(rates, TOP_FUNNEL), "step", "conversion_rate")


def pct_of_top_first_value(t: FunnelTables) -> DataFrame:
    rates = step_rates(
        stage_counts(t, TOP_FUNNEL), "first", scale=1, zero_base=None, base_name="first_count", text=True
    )
    return _ordered(_listed(rates, TOP_FUNNEL), "step", "conversion_rate")


def pct_of_previous_from_signup(t: FunnelTables) -> DataFrame:
    rates = step_rates(stage_counts(t, SIGNUP_FUNNEL), "previous", scale=1, text=True)
    return _ordered(_listed(rates, SIGNUP_FUNNEL), "step", "conversion_rate")


def pct_of_top_from_signup(t: FunnelTables) -> DataFrame:
    rates = step_rates(
        stage_counts(t, SIGNUP_TOP_FUNNEL), "first", scale=1, zero_base=None, base_name="first_count", text=True
    )
    return _ordered(_listed(rates, SIGNUP_TOP_FUNNEL), "step", "conversion_rate")


def step_share_of_total(t: FunnelTables) -> DataFrame:
    """Each step's users as a share of all ids seen anywhere.

    The population mixes id domains (download keys, session ids and user ids
    as text), as the reference does; it is not a count of people.
    """
    ids = [("app_downloads", "app_download_key"), ("signups", "session_id"), ("ride_requests", "user_id"), ("reviews", "user_id")]
    shares = shares_of_ids(t, USER_FUNNEL, ids, scale=2)
    return _sorted_small(shares, "step_order").select("step", "count", "percentage_share")


# ---- by platform, age and hour --------------------------------------------

def ride_requests_by_platform_q(t: FunnelTables) -> DataFrame:
    return ride_requests_by_platform(t)


def platform_scorecard_q(t: FunnelTables) -> DataFrame:
    return platform_scorecard(t)


def signups_by_age_range(t: FunnelTables) -> DataFrame:
    return segment_counts(t.signups, ["age_range"], "count").orderBy(F.expr("age_range").asc_nulls_last())


def age_funnel_counts_q(t: FunnelTables) -> DataFrame:
    """Counts per age label; raw groups sharing a label are merged by MAX."""
    labelled = age_funnel_counts(t).selectExpr(f"{age_label_sql('age_range')} AS label", *AGE_MEASURES)
    merged = labelled.groupBy("label").agg(*[F.expr(f"max({m}) AS {m}") for m in AGE_MEASURES])
    return merged.orderBy(F.expr(f"{age_sort_key_sql('label')}").asc_nulls_last()).selectExpr(
        "label AS age_range",
        "downloads AS app_downloads_count",
        "signups AS sign_ups_count",
        "requests AS ride_requests_count",
        "completed AS completed_rides_count",
        "reviews AS reviews_count",
    )


def _guarded(num: str, den: str) -> str:
    return f"CASE WHEN {den} = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE {pct_sql(num, den, 2)} END"


def age_funnel_conversion(t: FunnelTables) -> DataFrame:
    """Counts per raw age group (labelled, not merged) with step rates.

    ``reviews_conv_rate`` divides by ride-requesting users, not by
    completing users, as in the reference.
    """
    out = age_funnel_counts(t).selectExpr(
        f"{age_label_sql('age_range')} AS label",
        "downloads",
        "CAST(0 AS DECIMAL(18,2)) AS downloads_conv_rate",
        "signups",
        f"{_guarded('signups', 'downloads')} AS signups_conv_rate",
        "requests",
        f"{_guarded('requests', 'signups')} AS requests_conv_rate",
        "completed AS rides",
        f"{_guarded('completed', 'requests')} AS rides_conv_rate",
        "reviews",
        f"{_guarded('reviews', 'requests')} AS reviews_conv_rate",
    )
    ordered = out.orderBy(F.expr(f"{age_sort_key_sql('label')}").asc_nulls_last())
    return ordered.withColumnRenamed("label", "age_range")


def requests_by_hour(t: FunnelTables) -> DataFrame:
    # at most 25 rows: hours 0-23 and NULL
    return _sorted_small(hourly_profile(t.ride_requests), F.col("hour_of_day").asc_nulls_last())


def requests_by_day_segment(t: FunnelTables) -> DataFrame:
    return bucket_hours(hourly_profile(t.ride_requests))


# ---- dashboard funnels (one pass each) ----------------------------------

# Step numbers and names of the three dashboard funnels.
GENERAL_STEPS = (
    SegmentStep(1, "Downloads", "download"),
    SegmentStep(2, "Signups", "signup"),
    SegmentStep(3, "Ride_Requests", "ride", "user_id IS NOT NULL", rides=True),
    SegmentStep(4, "Ride_Accepted", "ride", "accept_ts IS NOT NULL", rides=True),
    SegmentStep(5, "Completed_Rides", "ride", "dropoff_ts IS NOT NULL", rides=True),
    SegmentStep(6, "Payment", "ride", "paid", rides=True),
    SegmentStep(7, "Reviews", "ride", "reviewed", rides=True),
)
SEGMENTED_STEPS = (
    SegmentStep(1, "Downloads", "download"),
    SegmentStep(2, "Signups", "signup"),
    SegmentStep(3, "Ride_Requests", "ride", "user_id IS NOT NULL"),
    SegmentStep(4, "Ride_Accepted", "ride", "accept_ts IS NOT NULL"),
    SegmentStep(5, "Completed_Rides", "ride", "dropoff_ts IS NOT NULL", users=False, rides=True),
    SegmentStep(6, "Payment", "ride", "paid", users=False, rides=True),
    SegmentStep(7, "Reviews", "ride", "reviewed", users=False, rides=True),
)
ALT_STEPS = (
    SegmentStep(0, "download", "download"),
    SegmentStep(1, "signup", "signup", "signup_ts IS NOT NULL"),
    SegmentStep(2, "ride_requested", "ride", "request_ts IS NOT NULL", rides=True),
    SegmentStep(3, "ride_accepted", "ride", "accept_ts IS NOT NULL", rides=True),
    SegmentStep(4, "ride_completed", "ride", "cancel_ts IS NULL", rides=True),
    SegmentStep(5, "payment", "ride", "paid", rides=True),
    SegmentStep(6, "review", "user_review", rides=True),
)


def general_funnel(t: FunnelTables) -> DataFrame:
    """Seven steps over users reachable from a download; ride counts from step 3."""
    out = segmented_funnel(t, GENERAL_STEPS, keep_empty=True, absent=None)
    # one row per step (no segments)
    return _sorted_small(out, "step").selectExpr(
        "step AS funnel_step", "name AS funnel_name", "users AS user_count", "rides AS ride_count"
    )


def dashboard_rows(t: FunnelTables, shared: bool = True) -> DataFrame:
    """The dashboard dataset: steps x platform x age range x download day."""
    dims = [("platform", "platform"), ("age_range", "age_range"), ("download_date", day_start_sql("download_ts"))]
    return segmented_funnel(t, SEGMENTED_STEPS, dims, absent=0, shared=shared).selectExpr(
        "step AS funnel_step",
        "name AS funnel_name",
        "platform",
        "age_range",
        "download_date",
        "users AS user_count",
        "rides AS ride_count",
    )


def segmented_funnel_q(t: FunnelTables) -> DataFrame:
    """The dashboard dataset in the reference's order."""
    order = ["download_date", "funnel_step", "platform", "age_range"]
    return dashboard_rows(t).orderBy(*[F.expr(f"{c}").asc_nulls_last() for c in order])


def segmented_funnel_alt(t: FunnelTables) -> DataFrame:
    """Steps 0-6 with the alternative definitions: completed = not cancelled,
    reviews linked by user, a download day as DATE."""
    dims = [("platform", "platform"), ("age_range", "age_range"), ("download_dt", day_sql("download_ts"))]
    out = segmented_funnel(t, ALT_STEPS, dims, absent=0)
    cols = ["step", "name", "platform", "age_range", "download_dt"]
    return out.orderBy(*[F.expr(f"{c}").asc_nulls_last() for c in cols]).selectExpr(
        *cols, "users AS users_count", "rides AS count_rides"
    )


# Query key -> plan, in the reference's order.
PLANS = {
    "download_count": download_count,
    "signup_count": signup_count,
    "ride_request_count": ride_request_count,
    "requested_vs_completed": requested_vs_completed,
    "requested_and_unique_users": requested_and_unique_users,
    "average_ride_time": average_ride_time,
    "accepted_ride_count": accepted_ride_count,
    "payments_collected": payments_collected,
    "ride_requests_by_platform": ride_requests_by_platform_q,
    "signup_to_request_dropoff": signup_to_request_dropoff,
    "funnel_step_conversion": funnel_step_conversion,
    "funnel_conversion_and_dropoff": funnel_conversion_and_dropoff,
    "platform_scorecard": platform_scorecard_q,
    "signups_by_age_range": signups_by_age_range,
    "age_funnel_counts": age_funnel_counts_q,
    "age_funnel_conversion": age_funnel_conversion,
    "requests_by_hour": requests_by_hour,
    "requests_by_day_segment": requests_by_day_segment,
    "funnel_lowest_conversion": funnel_lowest_conversion,
    "unique_requesting_users": unique_requesting_users,
    "unique_completing_users": unique_completing_users,
    "signup_request_pct": signup_request_pct,
    "signup_completed_pct": signup_completed_pct,
    "pct_of_previous_wide": pct_of_previous_wide,
    "pct_of_previous_long": pct_of_previous_long,
    "pct_of_running_max": pct_of_running_max,
    "pct_of_top_first_value": pct_of_top_first_value,
    "pct_of_previous_from_signup": pct_of_previous_from_signup,
    "pct_of_top_from_signup": pct_of_top_from_signup,
    "step_share_of_total": step_share_of_total,
    "general_funnel": general_funnel,
    "segmented_funnel": segmented_funnel_q,
    "segmented_funnel_alt": segmented_funnel_alt,
}
