"""Funnel operators: DataFrame in, DataFrame out."""

from .bitmaps import DailyBitmaps, IdStore, bitmaps, members, merged
from .duration import stage_duration
from .hourly import bucket_hours, hourly_profile
from .segmented import SegmentStep, members_of, segmented_funnel
from .segments import platform_scorecard, ride_requests_by_platform, segment_counts, user_platforms, user_ride_activity
from .share import distinct_population, share_of_population, shares_of_ids
from .spec import FunnelSpec, Stage, spec
from .stage_counts import stage_counts
from .step_rates import base_count_sql, drop_off_text_sql, rate_sql, rate_text_sql, step_rates
from .user_flags import age_funnel_counts, user_stage_flags

__all__ = [
    "DailyBitmaps",
    "FunnelSpec",
    "IdStore",
    "SegmentStep",
    "Stage",
    "age_funnel_counts",
    "base_count_sql",
    "bitmaps",
    "bucket_hours",
    "distinct_population",
    "drop_off_text_sql",
    "hourly_profile",
    "members",
    "members_of",
    "merged",
    "platform_scorecard",
    "rate_sql",
    "rate_text_sql",
    "ride_requests_by_platform",
    "segment_counts",
    "segmented_funnel",
    "share_of_population",
    "shares_of_ids",
    "spec",
    "stage_counts",
    "stage_duration",
    "step_rates",
    "user_platforms",
    "user_ride_activity",
    "user_stage_flags",
]
