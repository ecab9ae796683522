"""Ride facts stored in buckets of users, so that the funnel's chain reads rides without a shuffle.

``store_rides`` joins rides, payments and reviews by ``ride_id`` once and keeps
the result (``paid`` and ``reviewed`` as flags) in buckets by ``user_id``,
sorted inside. A funnel by segment then meets the members of its segments
bucket by bucket: only the members are shuffled, to the same buckets.

A bucket cannot be split by adaptive execution, so a user with very many rides
must not be in one: rides of users with more than ``hot_rides`` rides, and rides
without a user, are stored beside the buckets in plain files. There are at most
(all rides / ``hot_rides``) such users. Their rides meet the members in a join of
two shuffles (or a broadcast, where adaptive execution finds one side small),
which adaptive execution splits.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import RIDE_REQUESTS
from .tables import FunnelTables

PAID, REVIEWED = "paid", "reviewed"
BUCKETS = 200
HOT_RIDES = 1_000_000


@dataclass(frozen=True)
class BucketedTables(FunnelTables):
    """The five tables; rides come in parts that already carry ``paid`` and ``reviewed``."""

    facts: tuple[DataFrame, ...] = field(default=())

    def items(self):
        return [(f.name, getattr(self, f.name)) for f in fields(FunnelTables)]

    @property
    def ride_parts(self) -> tuple[DataFrame, ...]:
        return self.facts


def ride_facts(tables: FunnelTables, approved: str = "Approved") -> DataFrame:
    """Ride requests with ``paid`` (an approved transaction names the ride) and ``reviewed`` (a review names it).

    Payments and reviews are distinct by ride before they meet the rides; rides
    without an id go around the joins.
    """
    paid = tables.transactions.where(F.col("charge_status") == approved).groupBy("ride_id").agg(F.expr("TRUE AS paid_hit"))
    reviewed = tables.reviews.where("ride_id IS NOT NULL").groupBy("ride_id").agg(F.expr("TRUE AS review_hit"))
    rides = tables.ride_requests.select(*RIDE_REQUESTS.names)
    known = rides.where("ride_id IS NOT NULL").join(paid, "ride_id", "left").join(reviewed, "ride_id", "left")
    known = known.selectExpr(*RIDE_REQUESTS.names, f"coalesce(paid_hit, FALSE) AS {PAID}", f"coalesce(review_hit, FALSE) AS {REVIEWED}")
    return known.unionByName(rides.where("ride_id IS NULL").selectExpr("*", f"FALSE AS {PAID}", f"FALSE AS {REVIEWED}"))


def store_rides(tables: FunnelTables, base: str, buckets: int = BUCKETS, hot_rides: int = HOT_RIDES) -> None:
    """Write the ride facts of ``tables`` below ``base``: ``bucketed`` by user, and ``hot`` beside it."""
    spark = tables.ride_requests.sparkSession
    facts = ride_facts(tables)
    counts = tables.ride_requests.where("user_id IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") > hot_rides).select(F.col("user_id").alias("hot_user"))
    marked = facts.join(hot, facts["user_id"] == hot["hot_user"], "left")
    # Both parts come from one written table: the joins run once.
    scratch = f"{base}/facts-{uuid.uuid4().hex[:8]}"
    marked.select(*facts.columns, (F.col("hot_user").isNotNull() | F.col("user_id").isNull()).alias("is_hot")).write.parquet(scratch)
    rows = spark.read.parquet(scratch)
    rows.where("is_hot").drop("is_hot").write.mode("overwrite").parquet(f"{base}/hot")
    name = f"stagewise_rides_{uuid.uuid4().hex[:12]}"
    cold = rows.where("NOT is_hot").drop("is_hot").repartition(buckets, "user_id")
    cold.write.mode("overwrite").option("path", f"{base}/bucketed").bucketBy(buckets, "user_id").sortBy("user_id").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    at = spark._jvm.org.apache.hadoop.fs.Path(scratch)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_rides(spark: SparkSession, base: str, buckets: int = BUCKETS) -> tuple[DataFrame, ...]:
    """The parts that :func:`store_rides` wrote with the same number of buckets."""
    kinds = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in RIDE_REQUESTS.fields], f"{PAID} boolean", f"{REVIEWED} boolean"])
    name = f"stagewise_rides_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TABLE {name} ({kinds}) USING parquet CLUSTERED BY (user_id) SORTED BY (user_id) INTO {buckets} BUCKETS LOCATION '{base}/bucketed'")
    cold = spark.table(name)
    cold.schema  # resolved now; the catalog entry is not needed any more
    spark.sql(f"DROP TABLE {name}")
    return cold, spark.read.schema(kinds).parquet(f"{base}/hot")


def with_stored_rides(tables: FunnelTables, base: str, buckets: int = BUCKETS) -> BucketedTables:
    """``tables`` whose rides are read from the stored facts."""
    parts = read_rides(tables.ride_requests.sparkSession, base, buckets)
    rides = parts[0].unionByName(parts[1]).select(*RIDE_REQUESTS.names)
    return BucketedTables(tables.app_downloads, tables.signups, rides, tables.transactions, tables.reviews, facts=parts)
