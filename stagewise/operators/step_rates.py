"""Step-to-step rates over an ordered list of stage counts.

The input is already aggregated (one row per stage), so the unpartitioned
window below runs over a handful of rows in one task; never apply it to
unaggregated data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.rates import as_text_sql, pct_capped_sql, pct_sql

MODES = ("previous", "first", "running_max")
BASE_NAMES = {"previous": "previous_count", "first": "first_count", "running_max": "max_count"}
_FRAME = "ORDER BY step_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def base_count_sql(mode: str, count: str = "`count`") -> str:
    """The denominator of each step's rate.

    ``previous``: the count of the step before (NULL on the first step);
    ``first``: the count of the first step ("percent of top");
    ``running_max``: the largest count so far. ``first`` and ``running_max``
    agree while counts do not grow and differ when a later step grows.
    """
    if mode == "previous":
        return f"lag({count}) OVER (ORDER BY step_order)"
    if mode == "first":
        return f"first({count}) OVER ({_FRAME})"
    if mode == "running_max":
        return f"max({count}) OVER ({_FRAME})"
    raise ValueError(f"mode must be one of {MODES}: {mode!r}")


def rate_sql(count: str, base: str, scale: int = 2, cap: int | None = None, zero_base: int | None = 0) -> str:
    """``count / base * 100`` as ``decimal(18, scale)``.

    ``zero_base``: value when the base is 0 (``None``: no rule, so NULL).
    ``cap``: ``least(rate, cap)``; LEAST skips NULLs, so the first step of a
    ``previous`` funnel then gets ``cap`` instead of NULL.
    """
    value = pct_capped_sql(count, base, scale, cap) if cap is not None else pct_sql(count, base, scale)
    if zero_base is None:
        return value
    return f"CASE WHEN {base} = 0 THEN CAST({zero_base} AS DECIMAL(18,{scale})) ELSE {value} END"


def rate_text_sql(count: str, base: str, scale: int = 1, cap: int | None = None, zero_base: int | None = 0) -> str:
    """:func:`rate_sql` rendered as ``'<rate>%'``.

    The zero-base value keeps its own scale (``'0%'``). Without a base a rate
    renders as ``'%'``, as SQL CONCAT does; with a base of 0 and no rule for
    it, it is NULL.
    """
    value = as_text_sql(rate_sql(count, base, scale, cap, zero_base=None))
    if zero_base is None:
        return f"CASE WHEN {base} = 0 THEN CAST(NULL AS STRING) ELSE {value} END"
    return f"CASE WHEN {base} = 0 THEN '{zero_base}%' ELSE {value} END"


def drop_off_text_sql(count: str, base: str, scale: int = 2, zero_base_text: str = "N/A") -> str:
    """``(base - count) / base * 100`` as text; negative when a step grows."""
    return f"CASE WHEN {base} = 0 THEN '{zero_base_text}' ELSE {as_text_sql(pct_sql(f'{base} - {count}', base, scale))} END"


def step_rates(
    counts: DataFrame,
    mode: str = "previous",
    scale: int = 2,
    cap: int | None = None,
    zero_base: int | None = 0,
    base_name: str | None = None,
    text: bool = False,
) -> DataFrame:
    """Add the denominator (``base_name``, by default named after the mode)
    and ``conversion_rate`` to ``step, step_order, count`` rows."""
    base_name = base_name or BASE_NAMES[mode]
    with_base = counts.selectExpr("*", f"{base_count_sql(mode)} AS {base_name}")
    make = rate_text_sql if text else rate_sql
    return with_base.selectExpr("*", f"{make('`count`', base_name, scale, cap, zero_base)} AS conversion_rate")
