"""Derive the five funnel tables from the driver's generated tables.

The rules are fixed in FIXTURES.md (section A) and mirrored by the DuckDB
oracle in :mod:`stagewise.plans.oracle`; both sides must produce identical
rows. Only integer arithmetic, ``%``, CASE and whole-minute offsets are used.

Every table is a narrow projection of one driver table except ``reviews``,
which joins ``lineitem`` to the completed rides on the order key. All of it
is plain DataFrame code, so the derivation scales with the driver tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import FunnelTables, conform

# Fixed values (FIXTURES.md, section A).
USER_ID_OFFSET = 1000000
DOWNLOAD_KEY_PREFIX = "dl-"
DOWNLOAD_EPOCH = "2021-01-01 00:00:00"
# c_mktsegment -> platform; any other segment is 'web'
IOS_SEGMENTS = ("AUTOMOBILE", "BUILDING")
ANDROID_SEGMENTS = ("FURNITURE", "HOUSEHOLD")
# c_nationkey % 7 -> age_range; 6 -> NULL
AGE_RANGES = ("18-24", "25-34", "35-44", "45-54", "55-64", "None")


def _minutes(n: Column | int) -> Column:
    mins = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(F.lit(0), F.lit(0), mins.cast("int"), F.lit(0))


def _download_ts(k: Column) -> Column:
    epoch = F.expr(f"TIMESTAMP_NTZ'{DOWNLOAD_EPOCH}'")
    return epoch + F.make_dt_interval((k % 365).cast("int"), ((k * 7) % 24).cast("int"), F.lit(0), F.lit(0))


def _age_range(nation: Column) -> Column:
    r = nation % 7
    expr = F.when(r == 0, F.lit(AGE_RANGES[0]))
    for i, label in enumerate(AGE_RANGES[1:], start=1):
        expr = expr.when(r == i, F.lit(label))
    return expr.otherwise(F.lit(None).cast("string"))


def _platform(segment: Column) -> Column:
    return (
        F.when(segment.isin(*IOS_SEGMENTS), F.lit("ios"))
        .when(segment.isin(*ANDROID_SEGMENTS), F.lit("android"))
        .otherwise(F.lit("web"))
    )


def _rides(orders: DataFrame) -> DataFrame:
    """Orders kept as rides, with helper flags ``_accepted`` / ``_completed``."""
    o = F.col("o_orderkey")
    k = F.col("o_custkey")
    hour = F.when(o % 5 == 0, 17).when(o % 5 == 1, 8).otherwise(o % 24)
    request_ts = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), hour.cast("int"), (o % 60).cast("int"), F.lit(0)
    )
    accepted = o % 10 != 0
    completed = accepted & (F.col("o_orderstatus") != "P") & (k % 7 != 2)
    return orders.where((k % 5 != 1) & ((k % 4 != 3) | (k % 50 == 7))).select(
        o.alias("ride_id"),
        (k + USER_ID_OFFSET).alias("user_id"),
        request_ts.alias("request_ts"),
        accepted.alias("_accepted"),
        completed.alias("_completed"),
        F.col("o_totalprice"),
        F.col("o_custkey"),
    )


def derive_tables(spark: SparkSession, base: str) -> FunnelTables:
    customer = spark.read.parquet(f"{base}/customer.parquet")
    orders = spark.read.parquet(f"{base}/orders.parquet")
    lineitem = spark.read.parquet(f"{base}/lineitem.parquet")

    k = F.col("c_custkey")
    key = F.concat(F.lit(DOWNLOAD_KEY_PREFIX), k.cast("string"))
    app_downloads = customer.select(
        key.alias("app_download_key"),
        _platform(F.col("c_mktsegment")).alias("platform"),
        _download_ts(k).alias("download_ts"),
    )
    signups = customer.where(k % 4 != 3).select(
        (k + USER_ID_OFFSET).alias("user_id"),
        key.alias("session_id"),
        (_download_ts(k) + F.make_dt_interval(F.lit(1), F.lit(0), F.lit(0), F.lit(0))).alias("signup_ts"),
        _age_range(F.col("c_nationkey")).alias("age_range"),
    )

    rides = _rides(orders)
    o = F.col("ride_id")
    req = F.col("request_ts")
    null_ts = F.lit(None).cast("timestamp_ntz")
    ride_requests = rides.select(
        "ride_id",
        "user_id",
        "request_ts",
        F.when(F.col("_accepted"), req + _minutes(3)).otherwise(null_ts).alias("accept_ts"),
        F.when(F.col("_completed"), req + _minutes(8 + o % 6)).otherwise(null_ts).alias("pickup_ts"),
        F.when(F.col("_completed"), req + _minutes(13 + o % 6 + o % 40)).otherwise(null_ts).alias("dropoff_ts"),
        F.when(~F.col("_completed") & (o % 11 != 0), req + _minutes(9)).otherwise(null_ts).alias("cancel_ts"),
    )

    completed = rides.where(F.col("_completed"))
    transactions = completed.select(
        "ride_id",
        F.col("o_totalprice").alias("purchase_amount_usd"),
        F.when(o % 17 == 0, F.lit("Decline"))
        .when(o % 19 != 0, F.lit("Approved"))
        .otherwise(F.lit(None).cast("string"))
        .alias("charge_status"),
    )

    reviewed_rides = completed.where(F.col("o_custkey") % 3 != 0).select("ride_id", "user_id")
    returned = lineitem.where(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")
    reviews = returned.join(reviewed_rides, returned.l_orderkey == reviewed_rides.ride_id).select(
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("long")).otherwise(F.col("ride_id")).alias("ride_id"),
        F.col("user_id"),
    )

    return FunnelTables(
        app_downloads=conform(app_downloads, "app_downloads"),
        signups=conform(signups, "signups"),
        ride_requests=conform(ride_requests, "ride_requests"),
        transactions=conform(transactions, "transactions"),
        reviews=conform(reviews, "reviews"),
    )
