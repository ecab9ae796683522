"""Column-level helpers: built-in Spark SQL expressions, no UDFs.

Each helper exists as a SQL expression builder (``*_sql``) and as a Column.
"""

from .labels import (
    GDPR_LABEL,
    HOUR_SEGMENT_OTHER,
    HOUR_SEGMENTS,
    age_label,
    age_label_sql,
    age_sort_key,
    age_sort_key_sql,
    bucket,
    bucket_sql,
    hour_segment,
    hour_segment_sql,
    quote,
)
from .rates import (
    as_text,
    as_text_sql,
    div_half_up,
    div_half_up_sql,
    mean,
    mean_sql,
    pct,
    pct_capped,
    pct_capped_sql,
    pct_sql,
    pct_text,
    scaled_sql,
)
from .time import (
    day,
    day_sql,
    day_start,
    day_start_sql,
    hour_of_day,
    hour_of_day_sql,
    micros_between,
    micros_between_sql,
    micros_to_interval,
    micros_to_interval_sql,
)

__all__ = [name for name in dir() if not name.startswith("_")]
