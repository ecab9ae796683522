"""The hand-made edge fixture of FIXTURES.md (section B) and its variants."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from stagewise.sources.schemas import SCHEMAS
from stagewise.sources.tables import FunnelTables


def ts(day: str, hm: str | None) -> dt.datetime | None:
    if hm is None:
        return None
    return dt.datetime.fromisoformat(f"{day} {hm}")


RIDE_DAY = "2021-02-01"

DOWNLOADS = [
    ("d1", "ios", ts("2021-01-01", "10:00")),
    ("d2", "ios", ts("2021-01-01", "23:59")),
    ("d3", "android", ts("2021-01-02", "00:00")),
    ("d4", "web", ts("2021-01-02", "09:00")),
    ("d5", None, ts("2021-01-03", "09:00")),
]
SIGNUP_ROWS = [(1, "d1", "18-24"), (2, "d2", "None"), (3, "d3", None), (4, "d4", "25-34")]
RIDES = [
    (10, 1, "07:59", "08:02", "08:05", "08:15", None),
    (11, 1, "09:30", None, None, None, "09:40"),
    (12, 2, "15:10", "15:13", None, None, None),
    (13, 3, "19:00", "19:03", "19:08", "19:28", None),
    (14, 9, "20:00", "20:03", "20:05", "20:20", None),
]
TRANSACTIONS = [(10, 10.25, "Approved"), (10, 5.00, "Approved"), (13, 20.50, "Decline"), (14, 8.10, "Approved"), (12, 3.00, None)]
REVIEWS = [(10, 1), (10, 1), (None, 2), (14, 9)]


def _signups(rows):
    by_key = {d[0]: d[2] for d in DOWNLOADS}
    return [(u, s, by_key[s] + dt.timedelta(days=1) if s in by_key else None, a) for u, s, a in rows]


def _rides(rows, day=RIDE_DAY):
    return [(r, u, *[ts(day, x) for x in rest]) for r, u, *rest in rows]


def rows(variant: str = "base") -> dict[str, list[tuple]]:
    data = {
        "app_downloads": list(DOWNLOADS),
        "signups": _signups(SIGNUP_ROWS),
        "ride_requests": _rides(RIDES),
        "transactions": list(TRANSACTIONS),
        "reviews": list(REVIEWS),
    }
    if variant == "empty":
        data = {k: [] for k in data}
    elif variant == "growing":
        # more requesting users than signups, and more reviewers than completers:
        # rates above 100 (capped), negative drop-offs, running max != first value
        extra = [(20 + i, 50 + i, "12:00", "12:03", None, None, "12:09") for i in range(4)]
        data["ride_requests"] += _rides(extra)
        data["reviews"] += [(20 + i, 50 + i) for i in range(4)] + [(None, 60), (None, 61)]
    elif variant == "duplicates":
        # a user with two sessions, a repeated ride row, a repeated signup row,
        # an unparsable age range and a ride without request time
        data["signups"] = _signups(SIGNUP_ROWS + [(1, "d5", "Unknown"), (4, "d4", "25-34")])
        data["ride_requests"] += _rides([RIDES[0], (15, 4, None, "10:00", "10:05", "10:25", None)])
        data["transactions"] += [(15, 7.35, "Approved"), (15, 7.35, "Approved")]
        data["reviews"] += [(15, 4), (None, 4)]
    elif variant != "base":
        raise ValueError(variant)
    return data


def tables(spark: SparkSession, variant: str = "base") -> FunnelTables:
    data = rows(variant)
    return FunnelTables(**{n: spark.createDataFrame(data[n], SCHEMAS[n]) for n in SCHEMAS})
