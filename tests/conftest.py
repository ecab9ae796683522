import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from stagewise.session import build_session

    s = build_session("local[4]", app_name="stagewise-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    """Each edge-fixture variant written as Parquet (exact types for DuckDB)."""
    import edge_fixture

    from stagewise.sources.tables import write_tables

    base = tmp_path_factory.mktemp("edge")
    for variant in ("base", "empty", "growing", "duplicates"):
        write_tables(edge_fixture.tables(spark, variant), str(base / variant))
    write_tables(hot_user_tables(spark, SF_SMALL), str(base / "hot_user"))
    write_tables(hot_session_tables(spark, SF_SMALL), str(base / "hot_session"))
    import random_tables

    for seed in RANDOM_SEEDS:
        write_tables(random_tables.tables(spark, seed), str(base / f"random{seed}"))
    return base


RANDOM_SEEDS = (1, 2, 3)


HOT_USER = 1000001


def hot_user_tables(spark, sf_dir):
    """Driver-derived tables where one user owns a third of all rides and their reviews."""
    from pyspark.sql import functions as F

    from stagewise.sources import FunnelTables, derive_tables

    t = derive_tables(spark, sf_dir)
    hot = F.expr(f"CASE WHEN ride_id % 3 = 0 THEN {HOT_USER} ELSE user_id END")
    return FunnelTables(
        t.app_downloads,
        t.signups,
        t.ride_requests.withColumn("user_id", hot),
        t.transactions,
        t.reviews.withColumn("user_id", hot),
    )


HOT_SESSION = "dl-1"


def hot_session_tables(spark, sf_dir):
    """Driver-derived tables where a third of all signups share one session id.

    The signups are spread over several partitions, as a large table would be:
    adaptive execution splits a skewed reduce partition along map tasks, and a
    single small input file would give it only one.
    """
    from pyspark.sql import functions as F

    from stagewise.sources import FunnelTables, derive_tables

    t = derive_tables(spark, sf_dir)
    hot = F.expr(f"CASE WHEN user_id % 3 = 0 THEN '{HOT_SESSION}' ELSE session_id END")
    signups = t.signups.withColumn("session_id", hot).repartition(8)
    return FunnelTables(t.app_downloads, signups, t.ride_requests, t.transactions, t.reviews)
