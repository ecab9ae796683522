"""Distinct-entity counts per funnel stage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import quote
from ..sources.tables import FunnelTables
from .spec import Stage


def _group_by_source(stages: Sequence[Stage]) -> dict[tuple[str, str], list[Stage]]:
    groups: dict[tuple[str, str], list[Stage]] = {}
    for s in stages:
        groups.setdefault((s.source, s.entity), []).append(s)
    return groups


def _flag_sql(stage: Stage) -> str:
    if stage.predicate is None:
        return "1"
    return f"CAST(coalesce({stage.predicate}, FALSE) AS INT)"


def unpivot_sql(rows: Sequence[Sequence[tuple[str, str]]]) -> str:
    """``inline(array(named_struct(...), ...))``: one output row per struct."""
    structs = [
        "named_struct(" + ", ".join(f"{quote(name)}, {expr}" for name, expr in fields) + ")" for fields in rows
    ]
    return f"inline(array({', '.join(structs)}))"


def stage_counts(tables: FunnelTables, stages: Sequence[Stage]) -> DataFrame:
    """``step, step_order, count`` with one row per stage, even when 0.

    Stages that read the same table and count the same entity share one scan
    and one aggregation: the table is reduced to one row per entity with a
    0/1 flag per stage (max over the entity's rows), then the flags are
    summed. That equals ``COUNT(DISTINCT entity) ... WHERE predicate`` for
    every stage at once, without Catalyst's Expand (which would copy each row
    once per distinct aggregate). Partial aggregation collapses a hot entity
    before the shuffle. The few result rows are unpivoted from the one-row
    total in a single projection.
    """
    parts = []
    for (source, entity), group in _group_by_source(stages).items():
        n = len(group)
        per_entity = (
            tables[source]
            .selectExpr(f"{entity} AS e", *[f"{_flag_sql(s)} AS f{i}" for i, s in enumerate(group)])
            .where("e IS NOT NULL")
            .groupBy("e")
            .agg(*[F.expr(f"max(f{i}) AS f{i}") for i in range(n)])
        )
        totals = per_entity.agg(*[F.expr(f"CAST(coalesce(sum(f{i}), 0) AS BIGINT) AS c{i}") for i in range(n)])
        rows = [
            [("step", quote(s.name)), ("step_order", f"CAST({s.order} AS INT)"), ("count", f"c{i}")]
            for i, s in enumerate(group)
        ]
        parts.append(totals.selectExpr(unpivot_sql(rows)))
    return reduce(DataFrame.unionByName, parts)
