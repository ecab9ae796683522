"""Labels, step names and bucket rules whose text is part of the results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output text that must equal the reference's.
GDPR_LABEL = "GDPR data"
# raw age_range values reported under GDPR_LABEL (besides NULL)
GDPR_RAW_VALUES = ("None",)
# sort key of GDPR_LABEL among the age ranges (after every numeric lower bound)
GDPR_SORT_KEY = 100
# Hour-of-day buckets, first matching rule wins: (label, lowest hour, highest hour).
# The rules overlap at hours 7 and 9 and leave 20-23 and NULL to the last label.
HOUR_SEGMENTS = (
    ("Morning-(0:00 - 7:00 hours) Less rush", None, 7),
    ("Morning-(8:00 - 9:00 hours) peak hours", 7, 9),
    ("Afternoon-(10:00 - 15:00 hours) moderate rush", 9, 15),
    ("Evening-(16:00 - 19:00 hours) Heavy rush", 16, 19),
)
HOUR_SEGMENT_OTHER = "Late Evening-(19:00 - 00:00 hours) Casual rides"


def quote(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def age_label_sql(age_range: str) -> str:
    """Raw ``age_range`` to its reported label: NULL and 'None' become GDPR."""
    raw = ", ".join(quote(v) for v in GDPR_RAW_VALUES)
    return f"CASE WHEN {age_range} IS NULL OR {age_range} IN ({raw}) THEN {quote(GDPR_LABEL)} ELSE {age_range} END"


def age_sort_key_sql(label: str) -> str:
    """Numeric lower bound of an ``lo-hi`` label; GDPR after all; unparsable NULL."""
    return (
        f"CASE WHEN {label} = {quote(GDPR_LABEL)} THEN {GDPR_SORT_KEY}"
        f" ELSE try_cast(split_part({label}, '-', 1) AS INT) END"
    )


def bucket_sql(value: str, rules: Sequence[tuple[str, int | None, int | None]], other: str) -> str:
    """First-match bucketing of a number by inclusive ``(label, lo, hi)`` rules."""
    whens = []
    for label, lo, hi in rules:
        conds = [c for c in (f"{value} >= {lo}" if lo is not None else None, f"{value} <= {hi}" if hi is not None else None) if c]
        whens.append(f"WHEN {' AND '.join(conds) or 'TRUE'} THEN {quote(label)}")
    return f"CASE {' '.join(whens)} ELSE {quote(other)} END"


def hour_segment_sql(hour: str) -> str:
    return bucket_sql(hour, HOUR_SEGMENTS, HOUR_SEGMENT_OTHER)


def age_label(age_range: str) -> Column:
    return F.expr(age_label_sql(age_range))


def age_sort_key(label: str) -> Column:
    return F.expr(age_sort_key_sql(label))


def bucket(value: str, rules: Sequence[tuple[str, int | None, int | None]], other: str) -> Column:
    return F.expr(bucket_sql(value, rules, other))


def hour_segment(hour: str) -> Column:
    return F.expr(hour_segment_sql(hour))
