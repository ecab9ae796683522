"""Rendezvous sharding of records by a stable key over weighted shards.

Every shard draws a number for the key; the record goes to the shard with the
highest ``-weight / ln(u)`` (the weighted form of highest random weight). The
shard depends on the key and the shards alone, so one shard more takes records
only into itself, about its weight's share of them.

Slots number a shard's records without gaps. A first pass writes the narrow
digest of each record with the scan partition that it came from; records are
then numbered within (scan partition, shard), whose sizes the input splits
bound, and shifted by the counts of the partitions before. No key, shard or
group of copies is ever gathered in one task, and the numbers come from a
written table, so a recomputed task cannot change them.

Defined results: a null key is a key of its own; a null text has no bytes;
repeated rows and equal keys go to one shard, with a slot each; an empty table
gives an empty result; only the key and the text are read, so further columns
with any names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import staged

SHARDS = 40


def rendezvous(key: Column, weights: list[float], seed: int = 0) -> Column:
    """Number of the shard of ``key``, from 0."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    scores = []
    for k, weight in enumerate(weights):
        if weight > 0:
            draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(k), F.lit(seed)), 11)
            scores.append(F.struct((F.lit(float(weight)) / -F.log((draw + 0.5) / float(1 << 53))).alias("score"), F.lit(-k).alias("shard")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def shard(docs: DataFrame, weights: list[float] | None = None, key: str = "doc_id", text: str = "text", grown: float | None = 1.0, seed: int = 0) -> DataFrame:
    """``docs`` digests with their places: ``key``, ``size``, ``text_crc32``, ``shard``, ``slot``, ``grown_shard``.

    ``grown`` is the weight of the shard that may be added; None leaves
    ``grown_shard`` null.
    """
    weights = [1.0] * SHARDS if weights is None else weights
    body = F.coalesce(F.col(text), F.lit(""))
    digest = docs.select(F.col(key).alias("key"), F.octet_length(body).cast("bigint").alias("bytes"), F.crc32(body.cast("binary")).alias("text_crc32"))
    digest = digest.select(
        "key",
        (F.col("bytes") + 16).alias("size"),
        "text_crc32",
        rendezvous(F.col("key"), weights, seed).alias("shard"),
        (rendezvous(F.col("key"), [*weights, grown], seed) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("row"),
    )
    digest = staged(digest, "shard-digest")
    counts = digest.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    placed = digest.withColumn("own", own).join(offsets, ["shard", "part"])
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("before") + F.col("own")).alias("slot"), "grown_shard")


def with_shard(docs: DataFrame, weights: list[float] | None = None, key: str = "doc_id", name: str = "shard", seed: int = 0) -> DataFrame:
    """``docs`` with the column ``name`` added, or replaced: one projection, no shuffle."""
    return docs.withColumn(name, rendezvous(F.col(key), [1.0] * SHARDS if weights is None else weights, seed))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
