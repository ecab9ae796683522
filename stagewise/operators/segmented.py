"""Segmented funnel in one pass (rewrite R2).

The naive form computes every step as its own branch: rescan the downloads,
re-join signups, ride requests, transactions and reviews, group by the
segment, then UNION the branches. Here each ride table is scanned once:

* downloads joined to signups, as the inner join plus the downloads without
  a signup (an anti join), gives each download its segment dimensions; the
  download and signup steps are counted from it in one keyed aggregation;
* ride rows: ride requests carrying one 0/1 flag per ride step (``paid`` and
  ``reviewed`` come from transactions and reviews reduced to distinct
  ``ride_id`` first), joined to the users' segments;
* one aggregation of the ride rows keyed by (segment, user) and by
  (segment, ride) in the same exchange turns the flags into exact distinct
  counts for all ride steps at once. Because it shuffles on its own keys,
  adaptive execution may split a skewed join partition (one user owning a
  large share of the rides) without adding a shuffle, and partial
  aggregation collapses the hot user's rows before the exchange.

Each branch of the naive form emits a row for a segment only if a row
qualifies; that is kept through a ``present`` flag. No step uses Expand.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.labels import quote
from ..session import ensure_checkpoint_dir
from ..sources.tables import FunnelTables
from .segments import APPROVED
from .stage_counts import unpivot_sql

GRAINS = ("download", "signup", "ride", "user_review")


@dataclass(frozen=True)
class SegmentStep:
    """One funnel step of a segmented funnel.

    ``grain``:
      * ``download``: distinct ``app_download_key`` per segment;
      * ``signup``: distinct users whose signups match ``predicate`` (any of
        their signup rows), placed in every segment of the user;
      * ``ride``: ride requests of reachable users matching ``predicate``, a
        SQL expression over the ride request columns plus two booleans,
        ``paid`` (an approved transaction exists for the ride) and
        ``reviewed`` (a review names the ride);
      * ``user_review``: reviews linked by ``user_id``; rides are the
        distinct non-NULL ``reviews.ride_id``.
    ``users`` / ``rides`` choose which counts the step reports.
    """

    order: int
    name: str
    grain: str
    predicate: str | None = None
    users: bool = True
    rides: bool = False


def _mentions(steps: Sequence[SegmentStep], word: str) -> bool:
    pat = re.compile(rf"\b{word}\b", re.IGNORECASE)
    return any(s.predicate and pat.search(s.predicate) for s in steps)


def _flag_sql(predicate: str | None) -> str:
    return "1" if predicate is None else f"CAST(coalesce({predicate}, FALSE) AS INT)"


def _row(step: SegmentStep, users: str, rides: str, present: str) -> list[tuple[str, str]]:
    return [
        ("step", f"CAST({step.order} AS INT)"),
        ("name", quote(step.name)),
        ("users", f"CAST({users} AS BIGINT)"),
        ("rides", f"CAST({rides} AS BIGINT)"),
        ("present", f"CAST({present} AS INT)"),
    ]


def _rows(df: DataFrame, dims: list[str], rows: list[list[tuple[str, str]]]) -> DataFrame:
    """One output row per step from one aggregated row.

    All steps are unpivoted from the same aggregate in a single projection;
    selecting each step's column in a separate branch would let column
    pruning split the shared aggregate into one recomputation per step.
    """
    return df.selectExpr(*dims, unpivot_sql(rows))


def _ride_rows(tables: FunnelTables, steps: Sequence[SegmentStep], user_dims: DataFrame) -> DataFrame:
    """Rides that hold a step, in the segments of their users: one row per ride row and segment.

    Each part of the rides meets the members on its own, so a part in buckets
    of users is read without a shuffle.
    """
    flags = [f"f{s.order}" for s in steps]
    any_flag = " OR ".join(f"{f} = 1" for f in flags)
    met = []
    for rides in tables.ride_parts or (_with_ride_flags(tables, steps),):
        flagged = rides.selectExpr("ride_id", "user_id", *[f"{_flag_sql(s.predicate)} AS {f}" for s, f in zip(steps, flags)]).where(any_flag)
        met.append(flagged.join(user_dims, "user_id"))
    return reduce(DataFrame.unionByName, met)


def _with_ride_flags(tables: FunnelTables, steps: Sequence[SegmentStep]) -> DataFrame:
    """Ride requests with the flags ``paid`` and ``reviewed`` that steps mention."""
    rides = tables.ride_requests
    extra = []
    joins = []
    if _mentions(steps, "paid"):
        paid = (
            tables.transactions.where(f"charge_status = {quote(APPROVED)}")
            .groupBy("ride_id")
            .agg(F.expr("TRUE AS paid_hit"))
        )
        joins.append(paid)
        extra.append("coalesce(paid_hit, FALSE) AS paid")
    if _mentions(steps, "reviewed"):
        reviewed = tables.reviews.where("ride_id IS NOT NULL").groupBy("ride_id").agg(F.expr("TRUE AS review_hit"))
        joins.append(reviewed)
        extra.append("coalesce(review_hit, FALSE) AS reviewed")
    if not extra:
        return rides
    # rides without an id can match nothing: they go around the joins, where they would share one partition
    known = reduce(lambda r, side: r.join(side, "ride_id", "left"), joins, rides.where("ride_id IS NOT NULL"))
    unknown = rides.where("ride_id IS NULL").selectExpr("*", *[f"FALSE AS {e.rpartition(' ')[2]}" for e in extra])
    return known.selectExpr(*rides.columns, *extra).unionByName(unknown)


def _two_grain_counts(rows: DataFrame, steps: Sequence[SegmentStep], dims: list[str], flags: list[str]) -> DataFrame:
    """Distinct users and distinct rides per segment for several 0/1 flags at once.

    Each row is emitted twice, keyed by its user (kind 0) and by its ride
    (kind 1), and reduced to one row per (segment, kind, id) with the max of
    every flag; summing the flags per segment then counts distinct users and
    distinct non-NULL rides. One exchange carries both grains (narrow rows,
    doubled), where Catalyst's Expand would copy each row once per distinct
    aggregate and step. Presence of a segment comes from the user rows (every
    qualifying row has a user). All steps leave in one unpivot.
    """
    ride_flags = [f for s, f in zip(steps, flags) if s.rides]
    with_rides = bool(ride_flags)
    keys = "named_struct('kind', 0, 'id', user_id)" + (", named_struct('kind', 1, 'id', ride_id)" if with_rides else "")
    keyed = rows.selectExpr(*dims, *flags, f"inline(array({keys}))")
    if with_rides and len(ride_flags) < len(flags):
        # a ride-keyed copy only matters when a ride-counting step holds for it
        keyed = keyed.where(f"kind = 0 OR {' OR '.join(f'{f} = 1' for f in ride_flags)}")
    per_id = keyed.groupBy(*dims, "kind", "id").agg(*[F.expr(f"max({f}) AS {f}") for f in flags])
    per_dims = per_id.groupBy(*dims).agg(
        *[F.expr(f"coalesce(sum(CASE WHEN kind = 0 THEN {f} END), 0) AS u_{f}") for f in flags],
        *[F.expr(f"coalesce(max(CASE WHEN kind = 0 THEN {f} END), 0) AS p_{f}") for f in flags],
        *[
            F.expr(f"coalesce(sum(CASE WHEN kind = 1 AND id IS NOT NULL THEN {f} END), 0) AS r_{f}")
            for f in ride_flags
        ],
    )
    return _rows(
        per_dims,
        dims,
        [_row(s, f"u_{f}", f"r_{f}" if f in ride_flags else "0", f"p_{f}") for s, f in zip(steps, flags)],
    )


def _reduced(tables: FunnelTables, dims: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Distinct downloads and distinct signups with the dimensions that each can tell, and all dimensions over their join.

    Only distinct keys are counted, so a key that repeats on both sides need
    not meet itself row by row. A dimension over columns of both sides keeps
    those columns and is computed on the joined rows. Downloads stay apart by
    platform in any case: distinct by the key alone they would be dealt by it
    already, and adaptive execution only splits joins of two plain shuffles.
    """
    sides = (tables.app_downloads, tables.signups)
    keys = (["app_download_key"], ["session_id", "user_id"])
    picked: tuple[list[str], list[str]] = ([], [])
    after = []
    for name, expr in dims:
        words = set(re.findall(r"\w+", expr))
        told = [[c for c in side.columns if c in words] for side in sides]
        if told[0] and told[1]:
            for cols, own, more in zip(picked, keys, told):
                cols.extend(c for c in more if c not in own and c not in cols)
            after.append(f"{expr} AS {name}")
        else:
            # A column under its own name gets no alias: one that is removed in some branches only would tell equal exchanges apart.
            picked[1 if told[1] else 0].append(name if expr == name else f"{expr} AS {name}")
            after.append(name)
    picked[0].append("platform AS of_platform")
    downloads, signups = (side.selectExpr(*own, *cols).distinct() for side, own, cols in zip(sides, keys, picked))
    return downloads, signups, after


def _download_signup_parts(downloads: DataFrame, signups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``downloads LEFT JOIN signups ON app_download_key = session_id`` as
    two disjoint parts: the inner join, and the downloads without a signup
    (signup columns NULL).

    Together they are the outer join's rows, but skew-safe: adaptive execution
    can split a hot key on either side of an inner join (only on the
    preserved side of an outer one), and the anti join meets session ids made
    distinct map-side, so a session shared by many signups collapses first.
    Each part is aggregated on its own, so the inner join keeps a stage to
    itself, which the skew split needs.
    """
    ad, sg = downloads, signups
    matched = ad.join(sg, ad.app_download_key == sg.session_id)
    sessions = sg.select("session_id").distinct()
    unmatched = ad.join(sessions, ad.app_download_key == sessions.session_id, "left_anti")
    nulls = [f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in sg.schema.fields]
    return matched, unmatched.selectExpr(*ad.columns, *nulls)


def _download_signup_counts(parts: Sequence[DataFrame], dims: list[str], steps: Sequence[SegmentStep]) -> DataFrame:
    """Download steps (distinct keys) and unconditional signup steps (distinct
    users) per segment.

    As in :func:`_two_grain_counts`, each row is keyed once by its download
    and once by its user and reduced to distinct keys; the parts hold
    disjoint download keys (and only the matched part has users), so their
    per-segment counts add up. A segment appears for every download row, so
    a download step is present wherever the segment exists.
    """
    counted = []
    for part in parts:
        keyed = part.selectExpr(
            *dims,
            "inline(array(named_struct('kind', 0, 'k', app_download_key, 'u', CAST(NULL AS BIGINT)),"
            " named_struct('kind', 1, 'k', CAST(NULL AS STRING), 'u', user_id)))",
        )
        counted.append(
            keyed.distinct()
            .groupBy(*dims)
            .agg(
                F.expr("count(CASE WHEN kind = 0 AND k IS NOT NULL THEN 1 END) AS n_dl"),
                F.expr("count(CASE WHEN kind = 1 AND u IS NOT NULL THEN 1 END) AS n_su"),
            )
        )
    per_dims = reduce(DataFrame.unionByName, counted).groupBy(*dims).agg(
        F.expr("sum(n_dl) AS n_dl"), F.expr("sum(n_su) AS n_su")
    )
    rows = [
        _row(s, "n_dl", "0", "1") if s.grain == "download" else _row(s, "n_su", "0", "n_su > 0") for s in steps
    ]
    return _rows(per_dims, dims, rows)


def _count_per_dims(df: DataFrame, dims: list[str], col: str) -> DataFrame:
    """Distinct non-NULL ``col`` per segment, as two plain aggregations."""
    return df.where(f"{col} IS NOT NULL").select(*dims, col).distinct().groupBy(*dims).agg(F.expr("count(*) AS n"))


def _members(matched: DataFrame, names: list[str]) -> DataFrame:
    """``user_id`` and its segments, distinct.

    Never distinct by the user alone, for the same reason as in _reduced. The
    user leaves as the result of an aggregate: the filter on it that a join
    infers then stays above the common exchange, which so remains the same for
    all branches.
    """
    grouped = matched.withColumnRenamed("user_id", "of_user").groupBy("of_user", *(names or ["of_platform"])).agg(F.expr("max(of_user) AS user_id"))
    return grouped.select("user_id", *names)


def _written_members(members: DataFrame) -> DataFrame:
    """``members`` as a written table, within the range of its users.

    The range reaches the ride scan as a pushed filter, and as a selection over
    a plain scan it lets Spark build a Bloom filter of the users for that scan.
    """
    spark = members.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/members-{uuid.uuid4().hex[:12]}"
    seen = Observation(f"members-{uuid.uuid4().hex[:12]}")
    members.where("user_id IS NOT NULL").observe(seen, F.expr("min(user_id) AS least"), F.expr("max(user_id) AS most")).write.parquet(path)
    back = spark.read.schema(members.schema).parquet(path)
    least, most = seen.get["least"], seen.get["most"]
    return back if least is None else back.where(F.col("user_id").between(F.lit(least), F.lit(most)))


def members_of(tables: FunnelTables, dims: Sequence[tuple[str, str]]) -> DataFrame:
    """``user_id`` and the segments that each user's downloads and signups give, distinct; dims as in :func:`segmented_funnel`."""
    names = [n for n, _ in dims]
    downloads, signups, told = _reduced(tables, dims)
    matched = downloads.join(signups, downloads.app_download_key == signups.session_id)
    return _members(matched.selectExpr(*told, "user_id", "of_platform"), names).where("user_id IS NOT NULL")


def segmented_funnel(
    tables: FunnelTables,
    steps: Sequence[SegmentStep],
    dims: Sequence[tuple[str, str]] = (),
    keep_empty: bool = False,
    absent: int | None = 0,
    shared: bool = True,
) -> DataFrame:
    """``step, name, <dims>, users, rides``: one row per step and segment.

    ``dims`` are ``(name, SQL expression)`` over a download row joined to its
    signup (e.g. ``platform``, ``age_range``, a day of ``download_ts``).
    ``keep_empty``: emit every step even when nothing qualifies (only
    meaningful without dims: the naive form's ungrouped aggregates). A count
    a step does not report is ``absent`` (NULL or 0).

    ``shared``: all branches reuse one exchange of the joined downloads and
    signups. Without it the users' segments are written first and read by the
    rides' branch. That pays when the downloads are narrowed to few (a range of
    days): rides of other users are then dropped at their scan, by the range of
    the users and by a Bloom filter of them, before they are shuffled.
    """
    for s in steps:
        if s.grain not in GRAINS:
            raise ValueError(f"unknown grain {s.grain!r} in step {s.name!r}")
    names = [n for n, _ in dims]
    downloads, signups, told = _reduced(tables, dims)
    cols = [*told, "app_download_key", "user_id", "of_platform"]
    matched, unmatched = (p.selectExpr(*cols) for p in _download_signup_parts(downloads, signups))
    if shared:
        # Dealt by all its columns: no branch can prune one below the exchange, so it is the same in each.
        matched = matched.repartition(*[F.col(c) for c in matched.columns])
    user_dims = _members(matched, names)
    if not shared:
        user_dims = _written_members(user_dims)

    parts: list[DataFrame] = []
    plain = [s for s in steps if s.grain == "download" or (s.grain == "signup" and s.predicate is None)]
    if plain:
        parts.append(_download_signup_counts([matched, unmatched], names, plain))
    for s in steps:
        if s.grain == "signup" and s.predicate is not None:
            # a user qualifies through any of their signup rows, in every segment of the user
            qualified = tables.signups.where(s.predicate).select("user_id")
            users = user_dims.join(qualified, "user_id", "left_semi")
            parts.append(_rows(_count_per_dims(users, names, "user_id"), names, [_row(s, "n", "0", "n > 0")]))
        elif s.grain == "user_review":
            rows = (
                tables.reviews.where("user_id IS NOT NULL")
                .select("user_id", "ride_id")
                .distinct()
                .selectExpr("user_id", "ride_id", "1 AS f")
                .join(user_dims, "user_id")
            )
            parts.append(_two_grain_counts(rows, [s], names, ["f"]))
    ride_steps = [s for s in steps if s.grain == "ride"]
    if ride_steps:
        rows = _ride_rows(tables, ride_steps, user_dims)
        parts.append(_two_grain_counts(rows, ride_steps, names, [f"f{s.order}" for s in ride_steps]))

    # every part holds complete rows for its own steps: no re-aggregation
    merged = reduce(DataFrame.unionByName, parts)
    if not keep_empty:
        merged = merged.where("present = 1")
    absent_sql = "CAST(NULL AS BIGINT)" if absent is None else f"CAST({absent} AS BIGINT)"

    def pick(col: str, orders: list[int]) -> str:
        if not orders:
            return f"{absent_sql} AS {col}"
        return f"CASE WHEN step IN ({', '.join(map(str, orders))}) THEN CAST({col} AS BIGINT) ELSE {absent_sql} END AS {col}"

    return merged.selectExpr(
        "step",
        "name",
        *names,
        pick("users", [s.order for s in steps if s.users]),
        pick("rides", [s.order for s in steps if s.rides]),
    )
