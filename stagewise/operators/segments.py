"""Counts by a dimension: platform scorecard, rides per platform, signups per age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import FunnelTables

APPROVED = "Approved"  # fixed value: charge_status of a collected payment

# An amount that is still to be summed: exact, so the total does not depend on
# the order, and far below a cent; totals are rounded once, at the end.
MONEY = "CAST(purchase_amount_usd AS DECIMAL(28,10))"


def segment_counts(df: DataFrame, dims: Sequence[str], name: str = "count") -> DataFrame:
    """``COUNT(*)`` per combination of ``dims`` (NULL is its own group)."""
    return df.groupBy(*dims).agg(F.expr(f"count(*) AS `{name}`"))


def user_platforms(tables: FunnelTables) -> DataFrame:
    """``platform, user_id, times``: how often a signup of the user meets a download of the platform.

    Both sides are counted before they meet, so a key that repeats on both
    makes one row for each pair of different rows, not of all.
    """
    ad = tables.app_downloads.groupBy("app_download_key", "platform").agg(F.expr("count(*) AS n_downloads"))
    sg = tables.signups.groupBy("session_id", "user_id").agg(F.expr("count(*) AS n_signups"))
    return ad.join(sg, ad.app_download_key == sg.session_id).selectExpr("platform", "user_id", "n_downloads * n_signups AS times")


def user_ride_activity(
    tables: FunnelTables,
    with_payments: bool,
    completed: str = "dropoff_ts IS NOT NULL",
) -> DataFrame:
    """Per user: ``requests`` (ride rows), and with payments ``paid_completed``
    (0/1: a completed ride with a transaction) and ``amount`` (sum over those
    transactions, not rounded).

    Ride requests are counted per user map-side, so only one row per user and
    partition crosses the shuffle, however many rides a hot user has.
    """
    rr = tables.ride_requests.where("user_id IS NOT NULL")
    requests = rr.groupBy("user_id").agg(F.expr("count(*) AS requests"))
    if not with_payments:
        return requests
    tx = tables.transactions.selectExpr("ride_id", f"{MONEY} AS amount")
    paid = (
        rr.where(completed)
        .select("ride_id", "user_id")
        .join(tx, "ride_id")
        .groupBy("user_id")
        .agg(F.expr("sum(amount) AS amount"), F.expr("1 AS paid_completed"))
    )
    return requests.join(paid, "user_id", "left").selectExpr(
        "user_id", "requests", "coalesce(paid_completed, 0) AS paid_completed", "amount"
    )


def ride_requests_by_platform(tables: FunnelTables) -> DataFrame:
    """``platform, ride_request_count``: rows of download ⋈ signup ⋈ ride request per platform.

    Equal to ``COUNT(*)`` over the three-way join: each user contributes
    (#download-signup pairs) x (#rides). Platforms without rides are absent.
    """
    activity = user_ride_activity(tables, with_payments=False)
    return (
        user_platforms(tables)
        .join(activity, "user_id")
        .groupBy("platform")
        .agg(F.expr("CAST(sum(requests * times) AS BIGINT) AS ride_request_count"))
    )


def platform_scorecard(tables: FunnelTables, completed: str = "dropoff_ts IS NOT NULL") -> DataFrame:
    """Per download platform: downloads, signups, ride requests, completing users, payments.

    The spine is every platform seen in ``app_downloads``; metrics are
    attached by equality on platform, so a NULL platform keeps its download
    count and shows 0 elsewhere. ``total_payment_amount`` sums every
    transaction of a completed ride regardless of ``charge_status``.
    """
    spine = segment_counts(tables.app_downloads, ["platform"], "app_downloads")
    activity = user_ride_activity(tables, with_payments=True, completed=completed)
    per_user = (
        user_platforms(tables)
        .where("user_id IS NOT NULL")
        .join(activity, "user_id", "left")
        .groupBy("platform", "user_id")
        .agg(
            F.expr("sum(times) AS mult"),
            F.expr("max(coalesce(requests, 0)) AS requests"),
            F.expr("max(coalesce(paid_completed, 0)) AS paid_completed"),
            F.expr("max(amount) AS amount"),
        )
    )
    stats = per_user.groupBy("platform").agg(
        F.expr("count(*) AS signups"),
        F.expr("sum(mult * requests) AS ride_requests"),
        F.expr("sum(paid_completed) AS completed_rides"),
        F.expr("sum(CAST(amount AS DECIMAL(27,10)) * CAST(mult AS DECIMAL(10,0))) AS total_payment_amount"),
    )
    return spine.join(stats, "platform", "left").selectExpr(
        "platform",
        "app_downloads",
        *[f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("signups", "ride_requests", "completed_rides")],
        "CAST(coalesce(total_payment_amount, 0) AS DECIMAL(38,2)) AS total_payment_amount",
    )
