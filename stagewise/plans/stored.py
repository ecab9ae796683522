"""Queries over what the library stores: published days, bucketed rides, day folders, bitmaps.

Each takes a session and a data folder, writes its stores below the shared
folder of the session, and returns a DataFrame that reads them. Their SQL
computes the same rows from the tables alone.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.time import day_sql
from ..operators.bitmaps import DailyBitmaps, IdStore, bitmaps, members, merged
from ..operators.segmented import members_of
from ..session import ensure_checkpoint_dir
from ..sources import buckets as rides_in_buckets
from ..sources.days import REQUEST_DAY, downloaded, read_by_day, store_by_day
from ..sources.handoff import publish, read_published
from ..sources.tables import FunnelTables, load_tables
from .oracle import TABLES_SQL, Q, build
from .queries import SEGMENTED_STEPS, dashboard_rows

#: The range of download days that ``day_range_funnel`` reports.
FIRST_DAY, LAST_DAY = datetime.date(2021, 2, 1), datetime.date(2021, 4, 30)
#: How many days ``busiest_days_by_hour`` reports.
BUSIEST = 10
AUDIT = {"group": "funnel_step", "groups": [s.order for s in SEGMENTED_STEPS], "measures": ["user_count", "ride_count"]}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def dashboard_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard dataset as a reader of the published folder finds it: all days, then the first day once more."""
    t = load_tables(spark, sf_dir)
    done = publish(dashboard_rows(t), _folder(spark, "dashboard"), "download_date", **AUDIT)
    first = t.app_downloads.agg(F.expr(f"min({day_sql('download_ts')})")).first()[0]
    if first is not None:
        publish(dashboard_rows(downloaded(t, first, first), shared=False), done.path, "download_date", days=(first, first), **AUDIT)
    return read_published(spark, done)


def bucketed_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard dataset from ride facts in buckets of users."""
    t = load_tables(spark, sf_dir)
    base = _folder(spark, "rides")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rides_in_buckets.store_rides(t, base, n)
    return dashboard_rows(rides_in_buckets.with_stored_rides(t, base, n))


def day_range_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard dataset of a range of download days; other days' folders are not read."""
    base = _folder(spark, "days")
    store_by_day(load_tables(spark, sf_dir), base)
    return dashboard_rows(read_by_day(spark, base).downloaded(FIRST_DAY, LAST_DAY), shared=False)


def busiest_days_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by hour on the days with the most requests (ties: the earlier day)."""
    base = _folder(spark, "days")
    store_by_day(load_tables(spark, sf_dir), base)
    return busiest_by_hour(read_by_day(spark, base))


def busiest_by_hour(stored, most: int = BUSIEST) -> DataFrame:
    # One row per day; their ranks need one task, their number is that of the days.
    per_day = stored.ride_requests.where(f"{REQUEST_DAY} IS NOT NULL").groupBy(F.col(REQUEST_DAY).alias("day")).agg(F.count("*").alias("n"))
    days = per_day.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "day"))).where(F.col("place") <= most).select("day")
    rides = stored.requested_on(days)
    return rides.groupBy(F.col(REQUEST_DAY).alias("request_day"), F.expr("CAST(hour(request_ts) AS INT) AS hour_of_day")).agg(F.count("*").alias("request_count"))


def _user_steps(t: FunnelTables, *more: str) -> DataFrame:
    """``user_id, step`` (and what ``more`` says of a ride), distinct: the ride steps that a user took."""
    steps = "inline(filter(array(named_struct('step', 'requested', 'hit', TRUE), named_struct('step', 'accepted', 'hit', accept_ts IS NOT NULL), named_struct('step', 'completed', 'hit', dropoff_ts IS NOT NULL)), x -> x.hit))"
    return t.ride_requests.where("user_id IS NOT NULL").selectExpr("user_id", *more, steps).drop("hit").distinct()


def segment_users_by_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by step, platform and age range, and by step and platform: both counted from one stored set of bitmaps."""
    t = load_tables(spark, sf_dir)
    base = _folder(spark, "bitmaps")
    of_user = members_of(t, [("platform", "platform"), ("age_range", "age_range")])
    ids = IdStore(spark, f"{base}/ids").extend(t.signups.selectExpr("user_id AS id"))
    rows = _user_steps(t).join(of_user, "user_id").join(ids, F.col("user_id") == F.col("id"))
    bitmaps(rows, ["step", "platform", "age_range"]).write.parquet(f"{base}/users")
    stored = spark.read.schema("step string, platform string, age_range string, bucket bigint, bits binary").parquet(f"{base}/users")
    by_platform = members(merged([stored], ["step", "platform"]), ["step", "platform"], "platform_users")
    counts = members(stored, ["step", "platform", "age_range"]).join(by_platform.withColumnRenamed("platform", "of").withColumnRenamed("step", "at"), F.expr("step = at AND platform <=> of"))
    return counts.select("step", "platform", "age_range", "users", "platform_users")


def merged_daily_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by step and platform over all request days, added day range by day range to a stored running total."""
    t = load_tables(spark, sf_dir)
    base = _folder(spark, "daily")
    of_user = members_of(t, [("platform", "platform")])
    ids = IdStore(spark, f"{base}/ids").extend(t.signups.selectExpr("user_id AS id"))
    rows = _user_steps(t, f"{day_sql('request_ts')} AS day").where("day IS NOT NULL").join(of_user, "user_id").join(ids, F.col("user_id") == F.col("id"))
    state = DailyBitmaps(spark, base, ("step", "platform"))
    ends = t.ride_requests.agg(F.expr(f"min({day_sql('request_ts')})"), F.expr(f"max({day_sql('request_ts')})")).first()
    total = bitmaps(rows.limit(0), ["step", "platform"])
    if ends[0] is not None:
        cuts = [ends[0] + (ends[1] - ends[0]) * k / 3 for k in (1, 2)] + [ends[1]]
        since = ends[0]
        for cut in cuts:
            state.add(rows.where(F.col("day").between(F.lit(since), F.lit(cut))))
            total = state.total(cut.isoformat())
            since = cut + datetime.timedelta(days=1)
    return members(total, ["step", "platform"])


QUERIES = {
    "dashboard_handoff": dashboard_handoff,
    "bucketed_funnel": bucketed_funnel,
    "day_range_funnel": day_range_funnel,
    "busiest_days_by_hour": busiest_days_by_hour,
    "segment_users_by_bitmap": segment_users_by_bitmap,
    "merged_daily_users": merged_daily_users,
}

_DASHBOARD = Q["segmented_funnel"]
_TAKEN = (
    "taken AS (SELECT user_id, ride_id, request_ts, 'requested' AS step FROM ride_requests"
    " UNION ALL SELECT user_id, ride_id, request_ts, 'accepted' FROM ride_requests WHERE accept_ts IS NOT NULL"
    " UNION ALL SELECT user_id, ride_id, request_ts, 'completed' FROM ride_requests WHERE dropoff_ts IS NOT NULL),\n"
    "people AS (SELECT platform, age_range, user_id FROM app_downloads JOIN signups ON session_id = app_download_key)"
)

STORED_Q = {
    "dashboard_handoff": _DASHBOARD,
    "bucketed_funnel": _DASHBOARD,
    "day_range_funnel": (
        f"SELECT * FROM ({_DASHBOARD[0]}) whole WHERE CAST(download_date AS DATE) BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}'",
        _DASHBOARD[1],
    ),
    "busiest_days_by_hour": (
        "SELECT CAST(request_ts AS DATE) AS request_day, CAST(EXTRACT(hour FROM request_ts) AS INTEGER) AS hour_of_day, COUNT(*) AS request_count"
        " FROM ride_requests WHERE CAST(request_ts AS DATE) IN (SELECT day FROM most) GROUP BY 1, 2",
        "most AS (SELECT CAST(request_ts AS DATE) AS day FROM ride_requests WHERE request_ts IS NOT NULL"
        f" GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT {BUSIEST})",
    ),
    "segment_users_by_bitmap": (
        "SELECT fine.step, fine.platform, age_range, users, platform_users"
        " FROM (SELECT step, platform, age_range, COUNT(DISTINCT user_id) AS users FROM taken JOIN people USING (user_id) GROUP BY ALL) fine"
        " JOIN (SELECT step, platform, COUNT(DISTINCT user_id) AS platform_users FROM taken JOIN people USING (user_id) GROUP BY ALL) coarse"
        " ON coarse.step = fine.step AND coarse.platform IS NOT DISTINCT FROM fine.platform",
        _TAKEN,
    ),
    "merged_daily_users": (
        "SELECT step, platform, COUNT(DISTINCT user_id) AS users FROM taken JOIN people USING (user_id) WHERE request_ts IS NOT NULL GROUP BY ALL",
        _TAKEN,
    ),
}


def oracle_statements(tables_sql: str | None = TABLES_SQL) -> dict[str, str]:
    return {name: build(q, tables_sql) for name, q in STORED_Q.items()}


ORACLE_SQL = oracle_statements()
