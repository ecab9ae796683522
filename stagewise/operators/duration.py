"""Mean time between two stage timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import div_half_up_sql
from ..functions.time import micros_between_sql, micros_to_interval_sql


def stage_duration(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row: ``rides``, ``average_us`` (mean of ``end - start`` in whole
    microseconds, half away from zero) and ``average`` (the same as a
    day-time interval). Rows with either timestamp NULL are skipped. The sum
    is a decimal: 64 bits hold the microseconds of about 3 billion rides only.
    """
    agg = df.where(f"{start} IS NOT NULL AND {end} IS NOT NULL").agg(
        F.expr("count(*) AS rides"), F.expr(f"sum(CAST({micros_between_sql(start, end)} AS DECIMAL(20,0))) AS total_us")
    )
    avg_us = div_half_up_sql("total_us", "rides")
    return agg.selectExpr("rides", f"{avg_us} AS average_us").selectExpr(
        "rides", "average_us", f"{micros_to_interval_sql('average_us')} AS average"
    )
