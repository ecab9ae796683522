"""Hand-off of the dashboard dataset by day: whole days are replaced, and what was written is audited.

A folder holds one partition per day. ``publish`` writes a frame's days with
dynamic partition overwrite: the new files stay in a staging folder until the
job commits, so a run that ends early leaves the old days as they were, and a
rerun replaces its days instead of adding to them. Days of the asked range that
have no rows any more are emptied after the commit.

Every row carries the run that wrote it. Rows, sums and a checksum are taken by
an observation while the rows pass to the files, and compared with what the
folder then returns for this run; ``verify`` repeats that later.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import quote

DAY, RUN = "published_day", "published_run"


class AuditError(RuntimeError):
    """The folder does not return what was written to it."""


@dataclass(frozen=True)
class Published:
    """What one run wrote: its name, and the metrics that its rows had on their way to the files."""

    run: str
    path: str
    schema: str
    metrics: dict[str, object]


def _metrics(columns: Sequence[str], group: str | None, groups: Sequence[object], measures: Sequence[str]) -> list:
    """Rows, a checksum that does not depend on the order, and the sum of each measure for each group."""
    row = ", ".join(f"`{c}`" for c in columns)
    out = [F.expr("count(*) AS `rows`"), F.expr(f"coalesce(sum(CAST(xxhash64({row}) AS DECIMAL(38,0))), 0) AS checksum")]
    for g in groups if group else ():
        here = f"`{group}` = {quote(g) if isinstance(g, str) else g}"
        out.append(F.expr(f"count(CASE WHEN {here} THEN 1 END) AS `rows of {g}`"))
        out += [F.expr(f"CAST(coalesce(sum(CASE WHEN {here} THEN `{m}` END), 0) AS DECIMAL(38,6)) AS `{m} of {g}`") for m in measures]
    return out


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, {RUN} string, {DAY} date").parquet(path)


def _empty_days(spark: SparkSession, path: str, schema: str, run: str, days: tuple[datetime.date, datetime.date]) -> list[str]:
    """Removes the days of the range of which no row is of this run."""
    rows = _stored(spark, path, schema).where(F.col(DAY).between(F.lit(days[0]), F.lit(days[1])))
    # a row for each stored day of the range
    left = rows.groupBy(DAY).agg(F.max(F.col(RUN) == run).alias("new")).where("NOT new").collect()
    gone = sorted(f"{path}/{DAY}={r[DAY].isoformat()}" for r in left)
    for folder in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return gone


def publish(
    df: DataFrame,
    path: str,
    day: str,
    days: tuple[datetime.date, datetime.date] | None = None,
    group: str | None = None,
    groups: Sequence[object] = (),
    measures: Sequence[str] = (),
) -> Published:
    """Replace the days of ``df`` below ``path``, and audit what was written.

    ``day`` is a SQL expression for the day of a row; rows without one are a
    partition of their own. With ``days``, first and last, all rows must lie in
    that range, and its days that ``df`` lacks are emptied; without, only the
    days of ``df`` are touched. ``group``, ``groups`` and ``measures`` name the
    sums to audit.
    """
    spark = df.sparkSession
    run = uuid.uuid4().hex
    out = df.selectExpr("*", f"{quote(run)} AS {RUN}", f"CAST({day} AS DATE) AS {DAY}")
    if days is not None:
        outside = F.raise_error(F.concat(F.lit("a row lies outside the days to publish: "), F.col(DAY).cast("string")))
        out = out.withColumn(DAY, F.when(F.col(DAY).isNull() | F.col(DAY).between(F.lit(days[0]), F.lit(days[1])), F.col(DAY)).otherwise(outside.cast("date")))
    # Files by day; adaptive execution splits a large day and merges small ones.
    seen = Observation(f"published-{run}")
    out = out.hint("rebalance", DAY).observe(seen, *_metrics(df.columns, group, groups, measures))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    done = Published(run, path, _schema(df), dict(seen.get))
    if days is not None:
        _empty_days(spark, path, done.schema, run, days)
    verify(spark, done, group, groups, measures)
    return done


def verify(spark: SparkSession, done: Published, group: str | None = None, groups: Sequence[object] = (), measures: Sequence[str] = ()) -> None:
    """Raises if the folder's rows of the run differ from those that were written."""
    rows = _stored(spark, done.path, done.schema)
    columns = [c for c in rows.columns if c not in (RUN, DAY)]
    found = rows.where(F.col(RUN) == done.run).agg(*_metrics(columns, group, groups, measures)).first().asDict()
    wrong = {k: (v, found.get(k)) for k, v in done.metrics.items() if found.get(k) != v}
    if wrong:
        raise AuditError(f"{done.path}: written and stored differ in " + ", ".join(f"{k} ({a} and {b})" for k, (a, b) in sorted(wrong.items())))


def read_published(spark: SparkSession, done: Published, days: tuple[datetime.date, datetime.date] | None = None) -> DataFrame:
    """The published rows, of all days or of a range: only the folders of these days are read."""
    rows = _stored(spark, done.path, done.schema)
    if days is not None:
        rows = rows.where(F.col(DAY).between(F.lit(days[0]), F.lit(days[1])))
    return rows.drop(RUN, DAY)
