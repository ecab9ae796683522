"""Schemas of the five funnel tables.

The reference ships no DDL; these follow how its queries use each column.
``signups`` carries no ``platform``: a user's platform is the platform of the
download whose key equals ``signups.session_id``.
"""

from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

APP_DOWNLOADS = StructType(
    [
        StructField("app_download_key", StringType()),
        StructField("platform", StringType()),
        StructField("download_ts", TimestampNTZType()),
    ]
)

SIGNUPS = StructType(
    [
        StructField("user_id", LongType()),
        StructField("session_id", StringType()),
        StructField("signup_ts", TimestampNTZType()),
        StructField("age_range", StringType()),
    ]
)

RIDE_REQUESTS = StructType(
    [
        StructField("ride_id", LongType()),
        StructField("user_id", LongType()),
        StructField("request_ts", TimestampNTZType()),
        StructField("accept_ts", TimestampNTZType()),
        StructField("pickup_ts", TimestampNTZType()),
        StructField("dropoff_ts", TimestampNTZType()),
        StructField("cancel_ts", TimestampNTZType()),
    ]
)

TRANSACTIONS = StructType(
    [
        StructField("ride_id", LongType()),
        StructField("purchase_amount_usd", DoubleType()),
        StructField("charge_status", StringType()),
    ]
)

REVIEWS = StructType(
    [
        StructField("ride_id", LongType()),
        StructField("user_id", LongType()),
    ]
)

SCHEMAS = {
    "app_downloads": APP_DOWNLOADS,
    "signups": SIGNUPS,
    "ride_requests": RIDE_REQUESTS,
    "transactions": TRANSACTIONS,
    "reviews": REVIEWS,
}

TABLE_NAMES = tuple(SCHEMAS)
