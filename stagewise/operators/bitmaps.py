"""Exact distinct counts that merge: bitmaps over dense ids.

A plain distinct count cannot be added up over days or segments. A bitmap can:
a set bit per member, kept in buckets of 32,768 bits, so that the counts of any
union are one OR and one popcount away and no id is looked at again.

``IdStore`` numbers ids without gaps, in the order in which they first come,
and keeps the numbers. ``DailyBitmaps`` keeps the bitmaps of each day; a rerun
of a day replaces it, and a running total is carried from day to day.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir

BUCKET, BITS = "bucket", "bits"


def bitmaps(rows: DataFrame, dims: Sequence[str], dense: str = "dense") -> DataFrame:
    """``dims, bucket, bits``: the members of each segment as bitmaps of their dense ids (from 1)."""
    placed = rows.selectExpr(*dims, f"bitmap_bucket_number({dense}) AS {BUCKET}", f"bitmap_bit_position({dense}) AS bit")
    # Equal rows leave before the aggregation of whole bitmaps, which takes 4 KB for each group.
    return placed.distinct().groupBy(*dims, BUCKET).agg(F.expr(f"bitmap_construct_agg(bit) AS {BITS}"))


def merged(parts: Sequence[DataFrame], dims: Sequence[str]) -> DataFrame:
    """The union of several sets of bitmaps, over ``dims`` (fewer dims roll segments up)."""
    rows = reduce(DataFrame.unionByName, [p.select(*dims, BUCKET, BITS) for p in parts])
    return rows.groupBy(*dims, BUCKET).agg(F.expr(f"bitmap_or_agg({BITS}) AS {BITS}"))


def members(maps: DataFrame, dims: Sequence[str], name: str = "users") -> DataFrame:
    """``dims, name``: exact number of members of each segment."""
    return maps.groupBy(*dims).agg(F.expr(f"CAST(sum(bitmap_count({BITS})) AS BIGINT) AS {name}"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@dataclass(frozen=True)
class IdStore:
    """Dense numbers of ids in a folder: ``id, dense`` (bigint). One writer at a time."""

    spark: SparkSession
    path: str

    def read(self) -> DataFrame:
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], "id bigint, dense bigint")
        return self.spark.read.schema("id bigint, dense bigint").parquet(self.path)

    def extend(self, ids: DataFrame) -> DataFrame:
        """Number the ids (column ``id``) that have none yet, after those that have; null ids get none.

        The new ids are ranked over ranges of them: rank inside a range plus
        the sizes of the ranges before. Ranges come from a written table, so a
        task that runs again finds the same ones.
        """
        known = self.read()
        fresh = ids.select(F.col("id").cast("bigint").alias("id")).where("id IS NOT NULL").distinct().join(known.select("id"), "id", "left_anti")
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        scratch = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/dense-{uuid.uuid4().hex[:12]}"
        fresh.repartitionByRange(width, "id").withColumn("part", F.spark_partition_id()).write.parquet(scratch)
        dealt = self.spark.read.schema("id bigint, part int").parquet(scratch)
        start = known.agg(F.max("dense")).first()[0] or 0
        sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
        # a row for each range
        before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        rank = F.row_number().over(Window.partitionBy("part").orderBy("id"))
        numbered = dealt.withColumn("rank", rank).join(F.broadcast(before), "part").select("id", (F.col("rank") + F.col("before") + F.lit(start)).cast("bigint").alias("dense"))
        numbered.write.mode("append").parquet(self.path)
        return self.read()


@dataclass(frozen=True)
class DailyBitmaps:
    """Bitmaps by day below a folder, with a running total.

    ``days/day=...`` holds each day's bitmaps, ``total/upto=...`` the union of
    all days up to that one. Adding a day costs that day and one merge; the
    counts over any set of days are a merge of their bitmaps.
    """

    spark: SparkSession
    path: str
    dims: tuple[str, ...]

    @property
    def _kind(self) -> str:
        types = "".join(f"`{d}` string, " for d in self.dims)
        return f"{types}{BUCKET} bigint, {BITS} binary"

    def _read(self, folder: str, column: str) -> DataFrame:
        if not _exists(self.spark, f"{self.path}/{folder}"):
            return self.spark.createDataFrame([], f"{self._kind}, {column} date")
        return self.spark.read.schema(f"{self._kind}, {column} date").parquet(f"{self.path}/{folder}")

    def days(self) -> DataFrame:
        return self._read("days", "day")

    def add(self, rows: DataFrame, day: str = "day", dense: str = "dense") -> None:
        """Add the rows of some days (``dims``, day, dense id): these days are replaced, others stay."""
        named = rows.selectExpr(*[f"CAST({d} AS STRING) AS {d}" for d in self.dims], f"CAST({day} AS DATE) AS day", f"{dense} AS dense")
        maps = bitmaps(named, [*self.dims, "day"])
        maps.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.path}/days")

    def total(self, upto: str) -> DataFrame:
        """The union of all days up to ``upto`` (a date as text), from the last stored total and the days after it; stored as a total in turn.

        A day that is replaced afterwards makes totals from it on stale;
        :meth:`forget` drops them.
        """
        totals = self._read("total", "upto")
        last = totals.where(F.col("upto") <= F.lit(upto).cast("date")).agg(F.max("upto")).first()[0]
        new = self.days().where(F.col("day") <= F.lit(upto).cast("date"))
        parts = [new if last is None else new.where(F.col("day") > F.lit(last))]
        if last is not None:
            parts.append(totals.where(F.col("upto") == F.lit(last)))
        if last is None or last.isoformat() != upto:
            out = merged(parts, self.dims).withColumn("upto", F.lit(upto).cast("date"))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upto").parquet(f"{self.path}/total")
        return self._read("total", "upto").where(F.col("upto") == F.lit(upto).cast("date")).select(*self.dims, BUCKET, BITS)

    def forget(self, since: str) -> None:
        """Drop the totals of ``since`` and later."""
        stale = self._read("total", "upto").where(F.col("upto") >= F.lit(since).cast("date")).select("upto").distinct().collect()  # a row for each stored total
        for r in stale:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/total/upto={r['upto'].isoformat()}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def counts(self, first: str, last: str, dims: Sequence[str] | None = None) -> DataFrame:
        """Members over a range of days, of all or of fewer dims."""
        dims = self.dims if dims is None else dims
        range_of = self.days().where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        return members(merged([range_of], dims), dims)
