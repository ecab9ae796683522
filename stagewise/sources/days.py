"""Funnel tables stored by day, so that a range of days reads only its folders.

``app_downloads`` is partitioned by the day of the download and
``ride_requests`` by the day of the request; the other tables have no day of
their own and stay whole. A range of download days is a predicate on the
partition column, which prunes folders before the scan; days that a query finds
at run time prune the same folders dynamically.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from ..functions.time import day_sql
from .schemas import SCHEMAS
from .tables import FunnelTables, check_schema

DOWNLOAD_DAY, REQUEST_DAY = "download_day", "request_day"
DAY_OF = {"app_downloads": (DOWNLOAD_DAY, "download_ts"), "ride_requests": (REQUEST_DAY, "request_ts")}


@dataclass(frozen=True)
class DayTables:
    """The five tables, two of them with their day as a partition column."""

    tables: FunnelTables
    app_downloads: DataFrame
    ride_requests: DataFrame

    def downloaded(self, first: datetime.date, last: datetime.date) -> FunnelTables:
        """The tables with the downloads of a range of days."""
        days = self.app_downloads.where(F.col(DOWNLOAD_DAY).between(F.lit(first), F.lit(last)))
        return replace(self.tables, app_downloads=days.drop(DOWNLOAD_DAY))

    def requested_on(self, days: DataFrame) -> DataFrame:
        """Ride requests of the days listed in ``days`` (``day``, distinct), with ``request_day``.

        The days are found while the query runs; the folders of other days are
        then not read.
        """
        return self.ride_requests.join(days, self.ride_requests[REQUEST_DAY] == days["day"]).drop("day")


def downloaded(tables: FunnelTables, first: datetime.date, last: datetime.date) -> FunnelTables:
    """The same range over tables without a day layout: a filter that Parquet statistics may help, but no folder is left out."""
    end = last + datetime.timedelta(days=1)
    kept = tables.app_downloads.where(f"download_ts >= TIMESTAMP_NTZ'{first.isoformat()} 00:00:00' AND download_ts < TIMESTAMP_NTZ'{end.isoformat()} 00:00:00'")
    return replace(tables, app_downloads=kept)


def store_by_day(tables: FunnelTables, base: str) -> None:
    """Write the five tables under ``base``, two of them by day."""
    for name, df in tables.items():
        path = f"{base}/{name}.parquet"
        if name in DAY_OF:
            column, ts = DAY_OF[name]
            days = df.selectExpr("*", f"{day_sql(ts)} AS {column}").hint("rebalance", column)
            days.write.mode("overwrite").partitionBy(column).parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)


def read_by_day(spark: SparkSession, base: str) -> DayTables:
    """Read tables that :func:`store_by_day` wrote."""
    # With its schema, as an empty table has no folder whose name could tell the day column.
    parts = {name: spark.read.schema(StructType([*SCHEMAS[name].fields, StructField(column, DateType())])).parquet(f"{base}/{name}.parquet") for name, (column, _) in DAY_OF.items()}
    whole = {name: check_schema(spark.read.parquet(f"{base}/{name}.parquet"), name) for name in SCHEMAS if name not in DAY_OF}
    return DayTables(FunnelTables(**{n: parts[n].drop(c) for n, (c, _) in DAY_OF.items()}, **whole), **parts)
