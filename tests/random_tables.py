"""Seeded random funnel tables with messy data: small key pools (so keys
repeat across and within tables), NULL keys and timestamps, repeated
transactions and reviews."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import SparkSession

from stagewise.sources.schemas import SCHEMAS
from stagewise.sources.tables import FunnelTables

PLATFORMS = ["ios", "android", "web", None]
AGES = ["18-24", "25-34", "None", None, "35-44"]
STATUSES = ["Approved", "Decline", None]


def _ts(rng: random.Random, base: dt.datetime, null_rate: float = 0.0):
    if rng.random() < null_rate:
        return None
    return base + dt.timedelta(minutes=rng.randrange(0, 60 * 24 * 5))


def rows(seed: int) -> dict[str, list[tuple]]:
    rng = random.Random(seed)
    t0 = dt.datetime(2021, 1, 1)
    keys = [f"k{i}" for i in range(40)]
    users = list(range(1, 30))
    downloads = [
        (rng.choice(keys + [None]), rng.choice(PLATFORMS), _ts(rng, t0)) for _ in range(45)
    ]
    signups = [
        (rng.choice(users + [None]), rng.choice(keys), _ts(rng, t0, 0.1), rng.choice(AGES)) for _ in range(35)
    ]
    rides = []
    for _ in range(120):
        req = _ts(rng, t0 + dt.timedelta(days=10), 0.05)
        acc = _ts(rng, t0 + dt.timedelta(days=10), 0.3)
        pick = _ts(rng, t0 + dt.timedelta(days=10), 0.5)
        drop = pick + dt.timedelta(minutes=rng.randrange(1, 40)) if pick and rng.random() < 0.9 else None
        cancel = _ts(rng, t0 + dt.timedelta(days=10), 0.6)
        rides.append((rng.choice(list(range(1, 90)) + [None]), rng.choice(users + [99, None]), req, acc, pick, drop, cancel))
    ride_ids = [r[0] for r in rides if r[0] is not None]
    transactions = [
        (rng.choice(ride_ids + [500]), round(rng.uniform(1, 80), 2), rng.choice(STATUSES)) for _ in range(70)
    ]
    reviews = [(rng.choice(ride_ids + [None]), rng.choice(users + [98])) for _ in range(60)]
    return {
        "app_downloads": downloads,
        "signups": signups,
        "ride_requests": rides,
        "transactions": transactions,
        "reviews": reviews,
    }


def tables(spark: SparkSession, seed: int) -> FunnelTables:
    data = rows(seed)
    return FunnelTables(**{n: spark.createDataFrame(data[n], SCHEMAS[n]) for n in SCHEMAS})
