"""Sink for the dashboard dataset (the segmented funnel handed to a BI tool)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_dashboard_dataset(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = ("funnel_step",),
    mode: str = "overwrite",
) -> None:
    """Write an aggregated funnel as Parquet, partitioned for dashboard filters.

    A ``rebalance`` hint on the partition columns groups each folder's rows
    into few files, while adaptive execution still splits a folder that is
    too large for one task and merges small ones
    (``spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled``); a
    plain ``repartition`` by the same columns would write each folder from a
    single task however large it grows.
    """
    cols = list(partition_by)
    out = df.hint("rebalance", *cols) if cols else df
    writer = out.write.mode(mode)
    if cols:
        writer = writer.partitionBy(*cols)
    writer.parquet(path)
