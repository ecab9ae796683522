"""Funnel stages as plain data.

A stage says which table it reads, which entity it counts (distinct, NULLs
excluded) and which rows qualify. Predicates and entities are SQL expression
strings, so a spec is a value that can be printed, compared and stored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Stage:
    name: str
    order: int
    source: str  # one of the FunnelTables fields
    entity: str = "user_id"  # SQL expression counted distinct
    predicate: str | None = None  # SQL boolean over the source row; NULL counts as false


FunnelSpec = Sequence[Stage]


def spec(*stages: tuple) -> tuple[Stage, ...]:
    """Build a spec from ``(name, source, entity, predicate)`` tuples, ordered 1..n."""
    return tuple(Stage(name, i, *rest) for i, (name, *rest) in enumerate(stages, start=1))


# Stage definitions used by the reference's funnels (fixed step names).
DOWNLOADS = ("App_Downloads", "app_downloads", "app_download_key")
SIGN_UPS = ("Sign_Ups", "signups", "user_id")
RIDE_REQUESTS = ("Ride_Requests", "ride_requests", "user_id")
COMPLETED_RIDES = ("Completed_Rides", "ride_requests", "user_id", "dropoff_ts IS NOT NULL")
REVIEWS = ("Reviews", "reviews", "user_id")

# Download -> review, unrestricted tables, distinct users per step.
USER_FUNNEL = spec(DOWNLOADS, SIGN_UPS, RIDE_REQUESTS, COMPLETED_RIDES, REVIEWS)
# The first three steps of USER_FUNNEL.
TOP_FUNNEL = spec(DOWNLOADS, SIGN_UPS, RIDE_REQUESTS)
# Signup-topped funnels with the two spellings of the step names.
SIGNUP_FUNNEL = spec(
    ("Signup", "signups", "user_id"),
    ("Ride_Requested", "ride_requests", "user_id"),
    ("Ride_Completed", "ride_requests", "user_id", "dropoff_ts IS NOT NULL"),
    ("Reviews", "reviews", "user_id"),
)
SIGNUP_TOP_FUNNEL = spec(
    SIGN_UPS,
    RIDE_REQUESTS,
    ("Ride_Completed", "ride_requests", "user_id", "dropoff_ts IS NOT NULL"),
    REVIEWS,
)
# USER_FUNNEL counting ids as text (the share-of-total report).
TEXT_ID_FUNNEL = spec(
    DOWNLOADS,
    ("Sign_Ups", "signups", "CAST(user_id AS STRING)"),
    ("Ride_Requests", "ride_requests", "CAST(user_id AS STRING)"),
    ("Completed_Rides", "ride_requests", "CAST(user_id AS STRING)", "dropoff_ts IS NOT NULL"),
    ("Reviews", "reviews", "CAST(user_id AS STRING)"),
)
