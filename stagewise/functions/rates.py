"""Exact rates and percentages.

Percentages are computed in integer arithmetic and rounded half away from
zero (the rounding of SQL ``ROUND(numeric, n)``), then returned as
``decimal(18, scale)``. No floating point is involved, so the result does
not depend on the engine or on evaluation order.

Division by zero or by NULL yields NULL (``try_divide`` semantics); the
reference leaves several of its ratios unguarded, where a database would
raise instead.

Each helper has a ``*_sql`` form that returns a Spark SQL expression over
column names or other expressions, and a Column form (one ``F.expr``). A
whole expression is handed to the JVM in one call instead of one call per
operator, which keeps plan construction cheap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unit(scale: int) -> str:
    return "1" if scale <= 0 else "0." + "0" * (scale - 1) + "1"


def div_half_up_sql(num: str, den: str, factor: int = 1) -> str:
    """``round(num * factor / den)`` half away from zero, as a long; NULL for a 0/NULL den.

    ``num`` and ``den`` are integral and ``den`` non-negative; ``div`` is
    exact integer division, so no rounding step can go astray. The numerator
    is a decimal, as a sum may pass 64 bits where the quotient does not.
    """
    n, d = f"CAST({num} AS DECIMAL(31,0))", f"CAST({den} AS DECIMAL(20,0))"
    q = f"((CAST({2 * factor} AS DECIMAL(7,0)) * abs({n}) + {d}) div (2 * {d}))"
    return f"(CASE WHEN {d} IS NULL OR {d} = 0 THEN CAST(NULL AS BIGINT) WHEN {n} < 0 THEN -{q} ELSE {q} END)"


def scaled_sql(q: str, scale: int) -> str:
    """Long ``q`` read as a decimal with ``scale`` fraction digits."""
    return f"CAST(CAST({q} AS DECIMAL(18,0)) * {_unit(scale)} AS DECIMAL(18,{scale}))"


def pct_sql(num: str, den: str, scale: int = 2) -> str:
    """``num / den * 100`` rounded to ``scale`` places, ``decimal(18, scale)``."""
    return scaled_sql(div_half_up_sql(num, den, 100 * 10**scale), scale)


def pct_capped_sql(num: str, den: str, scale: int = 2, cap: int = 100) -> str:
    """``round(least(num / den * 100, cap), scale)``.

    LEAST skips NULLs, so a NULL (or zero) denominator gives ``cap``.
    """
    return f"coalesce(least({pct_sql(num, den, scale)}, CAST({cap} AS DECIMAL(18,{scale}))), CAST({cap} AS DECIMAL(18,{scale})))"


def mean_sql(total: str, n: str, scale: int = 2) -> str:
    """``total / n`` rounded to ``scale`` places, ``decimal(18, scale)``."""
    return scaled_sql(div_half_up_sql(total, n, 10**scale), scale)


def as_text_sql(value: str, suffix: str = "%", prefix: str = "") -> str:
    """Render a value with a prefix/suffix the way SQL CONCAT does.

    CONCAT skips NULL arguments, so a NULL value renders as the bare affixes
    (``'%'``); ``concat_ws('')`` has that behaviour, ``concat`` does not.
    """
    parts = ([f"'{prefix}'"] if prefix else []) + [f"CAST({value} AS STRING)"] + ([f"'{suffix}'"] if suffix else [])
    return f"concat_ws('', {', '.join(parts)})"


def rate_or_null_sql(value: str, suffix: str = "%") -> str:
    """:func:`as_text_sql` that is NULL for a NULL value: a ratio without a denominator has no text."""
    return f"CASE WHEN {value} IS NOT NULL THEN {as_text_sql(value, suffix)} END"


def div_half_up(num: str, den: str, factor: int = 1) -> Column:
    return F.expr(div_half_up_sql(num, den, factor))


def pct(num: str, den: str, scale: int = 2) -> Column:
    return F.expr(pct_sql(num, den, scale))


def pct_capped(num: str, den: str, scale: int = 2, cap: int = 100) -> Column:
    return F.expr(pct_capped_sql(num, den, scale, cap))


def mean(total: str, n: str, scale: int = 2) -> Column:
    return F.expr(mean_sql(total, n, scale))


def as_text(value: str, suffix: str = "%", prefix: str = "") -> Column:
    return F.expr(as_text_sql(value, suffix, prefix))


def pct_text(num: str, den: str, scale: int = 1) -> Column:
    return F.expr(as_text_sql(pct_sql(num, den, scale)))
