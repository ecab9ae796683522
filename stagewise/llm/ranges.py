"""Running sums over the whole of a table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import shuffle_width, staged


def before(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with the sum of each expression over all rows that stand earlier in ``order``.

    Rows are dealt to ranges of the order and written; a range's own sums start
    from the totals of the ranges before it, of which there is one row each.
    """
    dealt = rows.select("*", *[e.alias(f"_{n}") for n, e in sums.items()])
    dealt = dealt.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    dealt = staged(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), name)
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    parts = parts.select(F.col("_part").alias("_of"), *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}_start") for n in sums])
    own = dealt.select("*", *[F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)).alias(f"_{n}_inside") for n in sums])
    met = own.join(F.broadcast(parts), F.col("_part") == F.col("_of"))  # a row for each range
    return met.select(*rows.columns, *[(F.col(f"_{n}_inside") + F.col(f"_{n}_start")).alias(n) for n in sums])
