"""Timestamp helpers for TIMESTAMP_NTZ inputs (SQL expression strings and Columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_start_sql(ts: str) -> str:
    """``DATE_TRUNC('day', ts)`` keeping the TIMESTAMP_NTZ type.

    Spark's ``date_trunc`` goes through the session's zone, where a day may
    start at 1:00; a date does not.
    """
    return f"CAST(to_date({ts}) AS TIMESTAMP_NTZ)"


def day_sql(ts: str) -> str:
    return f"to_date({ts})"


def hour_of_day_sql(ts: str) -> str:
    """``EXTRACT(HOUR FROM ts)`` as int; NULL for a NULL timestamp."""
    return f"CAST(hour({ts}) AS INT)"


def micros_between_sql(start: str, end: str) -> str:
    """``end - start`` in whole microseconds, exact for TIMESTAMP_NTZ."""
    return f"timestampdiff(MICROSECOND, {start}, {end})"


def micros_to_interval_sql(micros: str) -> str:
    """Microseconds as a day-time interval (the type of ``AVG(ts - ts)``)."""
    return f"make_dt_interval(0, 0, 0, CAST(CAST({micros} AS DECIMAL(38,0)) / 1000000 AS DECIMAL(18,6)))"


def day_start(ts: str) -> Column:
    return F.expr(day_start_sql(ts))


def day(ts: str) -> Column:
    return F.expr(day_sql(ts))


def hour_of_day(ts: str) -> Column:
    return F.expr(hour_of_day_sql(ts))


def micros_between(start: str, end: str) -> Column:
    return F.expr(micros_between_sql(start, end))


def micros_to_interval(micros: str) -> Column:
    return F.expr(micros_to_interval_sql(micros))
