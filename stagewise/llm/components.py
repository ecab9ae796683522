"""Connected components of an undirected graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import staged


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node``, ``label`` (the smallest node of its component) for all nodes of ``edges`` (a, b; bigint).

    With ``rounds``, at most so many: nodes of one label are then connected,
    but a component may still have several labels.

    Each step's edges and smallest neighbours are written tables: a node with
    a third of all edges is added up before the shuffle where its smallest
    neighbour is looked for, and is split by adaptive execution where its
    edges meet that neighbour.
    """
    at = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components-start")
    told, step = None, 0
    while step != rounds:
        step += 1
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "components-least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large, "components-large")
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "components-least")
        met = large.join(least, "a")
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        at = staged(small, "components-small")
        now = tuple(at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == told:
            break
        told = now
    if rounds is not None:
        at = at.groupBy("a").agg(F.min("b").alias("b"))
    # A forest of stars (or of trees, after a fixed number of rounds): every node but the centres has one edge.
    centres = at.select("b").join(at.select(F.col("a").alias("b")), "b", "left_anti").distinct()
    return at.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(centres.select(F.col("b").alias("node"), F.col("b").alias("label")))
