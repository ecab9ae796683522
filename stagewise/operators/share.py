"""Each stage's count as a share of a population of ids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import quote
from ..functions.rates import pct_sql
from ..sources.tables import FunnelTables
from .spec import Stage
from .stage_counts import unpivot_sql


def distinct_population(id_columns: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """One row, ``total_count``: distinct non-NULL ids over the union of columns.

    Ids are compared as text, so ids from different domains (download keys,
    session ids, user ids) are pooled as the reference pools them. Each
    branch is de-duplicated map-side before the one shuffle on the id.
    """
    branches = [df.selectExpr(f"CAST({c} AS STRING) AS id") for df, c in id_columns]
    ids = reduce(DataFrame.union, branches).where("id IS NOT NULL").distinct()
    return ids.agg(F.expr("count(*) AS total_count"))


def typed_key_sql(column: str, kind: str) -> list[str]:
    """An id as a typed key, ``(n, t)``: a number in ``n``, any other text in ``t``.

    A text that is a number's own decimal form is that number, so ids of both
    types meet where their texts are equal, and numbers never become text.
    """
    if kind != "string":
        return [f"CAST({column} AS BIGINT) AS n", "CAST(NULL AS STRING) AS t"]
    number = f"try_cast({column} AS BIGINT)"
    own = f"coalesce(CAST({number} AS STRING) = {column}, FALSE)"
    return [f"CASE WHEN {own} THEN {number} END AS n", f"CASE WHEN NOT {own} THEN {column} END AS t"]


def shares_of_ids(tables: FunnelTables, stages: Sequence[Stage], population: Sequence[tuple[str, str]], scale: int = 2) -> DataFrame:
    """``step, step_order, count, percentage_share`` of all ids in the population's columns, pooled as text.

    ``population`` lists (table, id column); stages count id columns too, by
    name. Every table is read once: a row becomes a typed key with its flags for
    each id column, one aggregation by the key takes the largest flags, and the
    sums of flags are all counts at once, the population's among them.
    """
    flags = [f"f{s.order}" for s in stages] + ["pooled"]
    wanted: dict[str, dict[str, dict[str, str]]] = {}
    for s in stages:
        hit = "1" if s.predicate is None else f"CAST(coalesce({s.predicate}, FALSE) AS INT)"
        wanted.setdefault(s.source, {}).setdefault(s.entity, {})[f"f{s.order}"] = hit
    for table, column in population:
        wanted.setdefault(table, {}).setdefault(column, {})["pooled"] = "1"
    parts = []
    for table, columns in wanted.items():
        kinds = dict(tables[table].dtypes)
        structs = []
        for column, marks in columns.items():
            fields = [*typed_key_sql(column, kinds[column]), *[f"{marks.get(f, '0')} AS {f}" for f in flags]]
            structs.append(f"struct({', '.join(fields)})")
        parts.append(tables[table].selectExpr(f"inline(array({', '.join(structs)}))"))
    keyed = reduce(DataFrame.unionByName, parts).where(f"(n IS NOT NULL OR t IS NOT NULL) AND greatest({', '.join(flags)}) = 1")
    per_id = keyed.groupBy("n", "t").agg(*[F.expr(f"max({f}) AS {f}") for f in flags])
    totals = per_id.agg(*[F.expr(f"CAST(coalesce(sum({f}), 0) AS BIGINT) AS {f}") for f in flags])
    rows = [
        [("step", quote(s.name)), ("step_order", f"CAST({s.order} AS INT)"), ("count", f"f{s.order}"), ("percentage_share", pct_sql(f"f{s.order}", "pooled", scale))]
        for s in stages
    ]
    return totals.selectExpr(unpivot_sql(rows))


def share_of_population(
    counts: DataFrame,
    id_columns: Sequence[tuple[DataFrame, str]],
    scale: int = 2,
) -> DataFrame:
    """Add ``percentage_share = count / total * 100`` to stage counts.

    The population total is a global aggregate, i.e. exactly one row, so
    broadcasting it to the stage rows is bounded by construction.
    """
    total = F.broadcast(distinct_population(id_columns))
    return counts.crossJoin(total).selectExpr(
        *[f"`{c}`" for c in counts.columns], f"{pct_sql('`count`', 'total_count', scale)} AS percentage_share"
    )
