"""Request profile by hour of day and its grouping into day segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import HOUR_SEGMENT_OTHER, HOUR_SEGMENTS, bucket_sql
from ..functions.rates import mean_sql
from ..functions.time import hour_of_day_sql


def hourly_profile(df: DataFrame, ts: str = "request_ts", name: str = "request_count") -> DataFrame:
    """``hour_of_day, <name>``: rows per hour of ``ts`` (NULL ts: NULL hour).

    At most 25 groups; partial aggregation makes the shuffle tiny at any scale.
    """
    return df.groupBy(F.expr(f"{hour_of_day_sql(ts)} AS hour_of_day")).agg(F.expr(f"count(*) AS {name}"))


def bucket_hours(
    profile: DataFrame,
    rules: Sequence[tuple[str, int | None, int | None]] = HOUR_SEGMENTS,
    other: str = HOUR_SEGMENT_OTHER,
    count: str = "request_count",
    scale: int = 2,
) -> DataFrame:
    """Per segment: total count and the mean over the hours present, ordered by
    the segment's first hour (a segment holding only the NULL hour sorts last).
    """
    out = profile.groupBy(F.expr(f"{bucket_sql('hour_of_day', rules, other)} AS request_segment")).agg(
        F.expr(f"CAST(sum({count}) AS BIGINT) AS total_request_count"),
        F.expr("count(*) AS hours"),
        F.expr("min(hour_of_day) AS first_hour"),
    )
    # one row per rule plus the catch-all: sorted in a single task
    return out.coalesce(1).sortWithinPartitions(F.col("first_hour").asc_nulls_last()).selectExpr(
        "request_segment",
        "total_request_count",
        f"{mean_sql('total_request_count', 'hours', scale)} AS average_per_hour_ride",
    )
