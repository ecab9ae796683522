"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source may enter the mix ``target / source size`` times on
average. The whole part is certain; the fractional parts are rounded together:
two documents meet, and words move from one's probability to the other's until
one of them is 0 or 1. The direction is drawn so that both expectations stay,
and the expected words of the pair stay exactly, so a source's words miss its
target by less than the one document that is left at the end.

The rounding is a reduction tree. A leaf holds at most about ``leaf_rows``
documents of one source (a source of any size has as many leaves as it needs,
dealt by a hash of id and text; equal rows are numbered and spread), leaves one undecided document, and the
undecided ones of ``fan_in`` leaves meet on the next level. Each level's rows
are written below the shared folder; draws come from the level, source and
leaf, and rows are sorted first, so reruns agree.

The targets are one row per source: sources by code point, null last, weigh
``weights`` in turn and share ``share`` times all words; a target stops at
``cap`` times its source, and the excess goes to the others by weight (the
water level is found with running sums over ranges of sources).

Defined results: null or empty text has size 0 and takes 0 words; a source
without words has target 0; a null source is a source of its own; ties are
ordered by hash and id, and rows that are equal in id and text are
interchangeable; an empty table gives an empty mix; further columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import NOT_SPACE, word_counts
from .ranges import before
from .scratch import keyed_rows, staged

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
LEAF_ROWS = 4096
FAN_IN = 1024
#: Closer to 0 or 1 than this, a probability is taken as decided.
NEAR = 1e-9


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes`` (source, source_size) with the columns ``place`` (from 1, by code point), ``weight`` and ``target``.

    Places and running sums are taken over ranges of sources, so their number
    may be that of the documents.
    """
    listed = before(sizes.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"place": F.col("one")}, "mix-sources")
    weighed = listed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("place", F.col("place") + 1).withColumn("ratio", F.col("source_size") / F.col("weight"))
    filled = before(weighed, [F.col("ratio").asc(), F.col("place").asc()], {"capped": cap * F.col("source_size"), "lighter": F.col("weight")}, "mix-ratios")
    total = filled.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weight"))
    filled = filled.crossJoin(F.broadcast(total))  # one row
    level = (share * F.col("all_words") - F.col("capped")) / (F.col("all_weight") - F.col("lighter"))
    filled = filled.withColumn("level", level)
    # The lowest ratio whose source does not reach its cap sets the level of all that follow.
    fits = filled.where(F.col("level") * F.col("weight") <= cap * F.col("source_size")).agg(F.min(F.struct("ratio", "place", "level")).alias("first"))
    out = filled.drop("level").crossJoin(F.broadcast(fits))  # one row
    limit = cap * F.col("source_size")
    target = F.coalesce(F.least(limit, F.col("first")["level"] * F.col("weight")), limit)
    return out.withColumn("target", target).drop("one", "ratio", "capped", "lighter", "all_words", "all_weight", "first")


def pivot(size: np.ndarray, prob: np.ndarray, draw: Callable[[], float]) -> int:
    """Round ``prob`` in place, pair by pair; the place that is left undecided, or -1.

    Documents come largest first, so what is left at the end tends to be small.
    """
    held = -1
    for k in range(len(size)):
        if prob[k] <= NEAR or prob[k] >= 1 - NEAR:
            prob[k] = round(prob[k])
            continue
        if held < 0:
            held = k
            continue
        a, b, p, q = size[held], size[k], prob[held], prob[k]
        up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))
        move = up if draw() * (up + down) < down else -down
        prob[held] = p = p + move / a
        prob[k] = q = q - move / b
        left = [i for i, x in ((held, p), (k, q)) if NEAR < x < 1 - NEAR]
        for i in (held, k):
            if i not in left:
                prob[i] = round(prob[i])
        held = left[0] if left else -1
    return held


def _rounder(level: int, last: bool, seed: int) -> Callable[[pa.Table], pa.Table]:
    def run(leaf: pa.Table) -> pa.Table:
        leaf = leaf.sort_by([("size", "descending"), ("hash", "ascending"), ("row", "ascending"), ("equal", "ascending")])
        random = np.random.Generator(np.random.PCG64([seed, level, leaf["place"][0].as_py(), leaf["leaf"][0].as_py()]))
        prob = leaf["prob"].to_numpy().copy()
        held = pivot(leaf["size"].to_numpy().astype(float), prob, random.random)
        if held >= 0 and last:
            prob[held] = float(random.random() < prob[held])
            held = -1
        leaf = leaf.set_column(leaf.schema.get_field_index("prob"), "prob", pa.array(prob))
        return leaf.set_column(leaf.schema.get_field_index("decided"), "decided", pa.array(np.arange(len(prob)) != held))

    return run


def copies(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, leaf_rows: int = LEAF_ROWS, fan_in: int = FAN_IN, seed: int = 0) -> DataFrame:
    """``rows`` (row, hash, equal, source, size) with ``source_size``, ``target`` and ``copies``, how often the mix takes each.

    ``equal`` numbers rows of one ``hash``: they are dealt to different leaves.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aims = staged(targets(sizes, weights, share, cap).withColumnRenamed("source", "of"), "mix-targets")
    most = aims.agg(F.max("n")).first()[0] or 0
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    leaves = F.ceil(F.col("n") / leaf_rows)
    state = (
        rows.join(aims, rows["source"].eqNullSafe(aims["of"]))
        .withColumn("times", times)
        .withColumn("whole", F.floor(F.col("times") + NEAR).cast("int"))
        .withColumn("prob", F.when(F.col("size") > 0, F.greatest(F.col("times") - F.col("whole"), F.lit(0.0))).otherwise(0.0))
        .withColumn("leaf", F.pmod(F.xxhash64("hash", "equal", F.lit(seed)), leaves))
        .withColumn("decided", F.lit(False))
        .select("row", "hash", "equal", "source", "size", "source_size", "target", "place", "leaf", "whole", "prob", "decided")
    )
    done, level, width = [], 0, math.ceil(most / leaf_rows)
    while True:
        rounded = staged(state.groupBy("place", "leaf").applyInArrow(_rounder(level, width <= 1, seed), state.schema), f"mix-level{level}")
        done.append(rounded.where("decided"))
        if width <= 1:
            break
        state = rounded.where("NOT decided").withColumn("leaf", F.floor(F.col("leaf") / fan_in))
        level, width = level + 1, math.ceil(width / fan_in)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumn("copies", F.col("whole") + F.round("prob").cast("int"))


def sized(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the column ``text`` replaced by ``size``, its words; null has none."""

    def count(texts: pa.Array) -> pa.Array:
        return pa.array(word_counts(texts, NOT_SPACE))

    return rows.withColumn("size", F.arrow_udf(count, "bigint")(F.col(text).cast("string"))).drop(text)


def mix(docs: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it was drawn, with the columns of ``docs``.

    Rows are named by their place in the files they are read from, so equal ids
    do no harm and the texts are not written again.
    """
    whole = keyed_rows(docs, "mix-rows")
    body = F.col(f"whole.{text}")
    rows = whole.select("row", F.xxhash64(f"whole.{id_col}", body).alias("hash"), F.xxhash64("row").alias("equal"), F.col(f"whole.{source}").alias("source"), body.alias("text"))
    sizes = staged(sized(rows), "mix-sizes")
    drawn = copies(sizes, **options).where("copies > 0").select(F.col("row").alias("drawn"), "copies")
    taken = whole.join(drawn, F.col("row") == F.col("drawn"))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*")


def digest(docs: DataFrame, **options) -> DataFrame:
    """The contract's columns, with the number of copies.

    Rows equal in id, text and source are counted first and then numbered, so
    that many of them are spread over many leaves.
    """
    rows = sized(docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("hash"), "text"))
    rows = rows.groupBy("doc_id", "source", "hash", "size").agg(F.count("*").alias("n"))
    rows = rows.select(F.col("doc_id").alias("row"), "source", "hash", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("equal"))
    got = copies(staged(rows, "mix-sizes"), **options)
    return got.select(F.col("row").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
