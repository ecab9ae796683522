"""Stage flags at user grain (rewrite R1) and the age-range funnel built on them.

The naive form joins signups to *all* ride requests and then to *all* reviews
of the same user, a many-to-many join whose size is rides x reviews per user,
and hides the blow-up behind COUNT(DISTINCT). Here rides and reviews are
first reduced to one row per user, so every join is at most one-to-one on
the user side and the distinct counts become sums of 0/1 flags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import FunnelTables


def user_stage_flags(tables: FunnelTables, completed: str = "dropoff_ts IS NOT NULL") -> DataFrame:
    """``user_id, requested, completed, reviewed`` (0/1), one row per requesting user.

    ``reviewed`` needs a ride request of the same user: reviews reach a user
    only through the user's ride requests. Both sides come out of an
    aggregation on ``user_id``, so the join adds no shuffle of its own.
    """
    rides = (
        tables.ride_requests.where("user_id IS NOT NULL")
        .groupBy("user_id")
        .agg(F.expr(f"max(CAST(coalesce({completed}, FALSE) AS INT)) AS completed"))
    )
    reviewers = tables.reviews.where("user_id IS NOT NULL").groupBy("user_id").agg(F.expr("1 AS reviewed"))
    return rides.join(reviewers, "user_id", "left").selectExpr(
        "user_id", "1 AS requested", "completed", "coalesce(reviewed, 0) AS reviewed"
    )


AGE_MEASURES = ["downloads", "signups", "requests", "completed", "reviews"]


def age_funnel_counts(tables: FunnelTables) -> DataFrame:
    """Per raw ``age_range``: distinct downloads, signups, requesting, completing and reviewing users.

    Only downloads whose signup has a non-NULL ``age_range`` are counted (the
    WHERE on the outer-joined side makes the join inner), so downloads per
    age range equal signups when every signup has its own download.
    """
    # Distinct by key and platform, not by key alone: dealt by the key already,
    # this side would have no shuffle of its own, and the join could not be split.
    ad = tables.app_downloads.where("app_download_key IS NOT NULL").select("app_download_key", "platform").distinct()
    sg = tables.signups.where("age_range IS NOT NULL").select("session_id", "user_id", "age_range").distinct()
    # One exchange by all columns, which both counts below start from; it also
    # lets adaptive execution split a hot session in the join.
    arrived = ad.join(sg, ad.app_download_key == sg.session_id).selectExpr("age_range", "app_download_key", "user_id AS of_user")
    arrived = arrived.repartition("age_range", "app_download_key", "of_user")
    downloads = arrived.select("age_range", "app_download_key").distinct().groupBy("age_range").agg(F.expr("count(*) AS downloads"))
    # The user as an aggregate's result: a filter on it stays above the common exchange.
    users = arrived.groupBy("age_range", "of_user").agg(F.expr("max(of_user) AS user_id"))
    did = users.join(user_stage_flags(tables), "user_id", "left").groupBy("age_range").agg(
        F.expr("count(user_id) AS signups"),
        F.expr("coalesce(sum(requested), 0) AS requests"),
        F.expr("coalesce(sum(completed), 0) AS completed"),
        F.expr("coalesce(sum(reviewed), 0) AS reviews"),
    )
    # Every age range has a download and a row of users; each side holds one row per range.
    return downloads.join(did, "age_range")
