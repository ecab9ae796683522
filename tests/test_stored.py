"""Published days, bucketed rides, day folders and bitmaps."""

import datetime
import glob
import os
import random
import shutil

import pytest
from compare import canonical, duck_type, duckdb_connection
from conftest import SF_SMALL, hot_user_tables
from pyspark.sql import functions as F
from test_plans import SKEW_CONF, _with_conf, plan_of

from stagewise.operators.bitmaps import DailyBitmaps, IdStore, bitmaps, members, merged
from stagewise.operators.share import distinct_population, shares_of_ids
from stagewise.operators.spec import USER_FUNNEL
from stagewise.plans import stored
from stagewise.plans.queries import PLANS, dashboard_rows
from stagewise.sources import read_tables
from stagewise.sources import buckets as B
from stagewise.sources import days as D
from stagewise.sources import handoff as H
from stagewise.sources.tables import FunnelTables

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
DAY1, DAY2, DAY3 = (datetime.date(2024, 5, d) for d in (1, 2, 3))


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    from stagewise.sources import derive_tables, write_tables

    path = str(tmp_path_factory.mktemp("stored"))
    write_tables(derive_tables(spark, SF_SMALL), path)
    return read_tables(spark, path)


@pytest.mark.parametrize("name", sorted(stored.QUERIES))
def test_queries_match_sql(spark, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF_SMALL)
    cur = duckdb_connection(SF_SMALL).execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    types = dict(zip(cols, [str(c[1]) for c in cur.description]))
    assert {c: duck_type(k) for c, k in df.dtypes} == types
    rows = [tuple(r) for r in df.collect()]
    assert canonical(df.columns, rows) == canonical(cols, cur.fetchall()) and rows


@pytest.mark.parametrize("variant", ["empty", "duplicates", "random1"])
@pytest.mark.parametrize("name", sorted(stored.QUERIES))
def test_edge_variants(spark, edge_dir, variant, name):
    import duckdb

    con = duckdb.connect()
    for table in ("app_downloads", "signups", "ride_requests", "transactions", "reviews"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{edge_dir / variant / table}.parquet/*.parquet')")
    cur = con.execute(stored.oracle_statements(None)[name])
    cols = [c[0] for c in cur.description]
    df = stored.QUERIES[name](spark, str(edge_dir / variant))
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(cols, cur.fetchall())


# ---- hand-off by day -----------------------------------------------------------


def rows_of(spark, *rows):
    return spark.createDataFrame(rows, "step int, day date, n long")


def back(spark, done):
    return sorted(map(tuple, H.read_published(spark, done).collect()), key=str)


AUDIT = {"group": "step", "groups": [1, 2], "measures": ["n"]}


def test_a_rerun_replaces_exactly_its_days(spark, tmp_path):
    path = str(tmp_path / "out")
    done = H.publish(rows_of(spark, (1, DAY1, 5), (2, DAY1, 3), (1, DAY2, 7), (1, DAY3, 9), (1, None, 1)), path, "day", **AUDIT)
    assert done.metrics["rows"] == 5 and done.metrics["n of 1"] == 22
    again = H.publish(rows_of(spark, (1, DAY2, 70), (2, DAY2, 1)), path, "day", days=(DAY2, DAY2), **AUDIT)
    assert back(spark, again) == sorted([(1, DAY1, 5), (2, DAY1, 3), (1, DAY2, 70), (2, DAY2, 1), (1, DAY3, 9), (1, None, 1)], key=str)
    # DAY2 and DAY3 are run again, and DAY3 has no rows any more
    H.publish(rows_of(spark, (1, DAY2, 8)), path, "day", days=(DAY2, DAY3), **AUDIT)
    assert back(spark, again) == sorted([(1, DAY1, 5), (2, DAY1, 3), (1, DAY2, 8), (1, None, 1)], key=str)


def test_rows_outside_the_days_end_the_run(spark, tmp_path):
    path = str(tmp_path / "out")
    done = H.publish(rows_of(spark, (1, DAY1, 5)), path, "day", **AUDIT)
    with pytest.raises(Exception, match="outside the days"):
        H.publish(rows_of(spark, (1, DAY1, 6), (1, DAY3, 6)), path, "day", days=(DAY1, DAY2), **AUDIT)
    assert back(spark, done) == [(1, DAY1, 5)]


def test_an_aborted_run_leaves_the_old_days(spark, tmp_path):
    path = str(tmp_path / "out")
    done = H.publish(rows_of(spark, (1, DAY1, 5), (1, DAY2, 6)), path, "day", **AUDIT)
    broken = spark.range(0, 4, 1, 4).selectExpr("1 AS step", "DATE'2024-05-01' + CAST(id % 2 AS INT) AS day", "CASE WHEN id = 3 THEN raise_error('lost') ELSE id END AS n")
    with pytest.raises(Exception, match="lost"):
        H.publish(broken, path, "day", **AUDIT)
    assert back(spark, done) == [(1, DAY1, 5), (1, DAY2, 6)]


def test_a_corrupted_folder_raises(spark, tmp_path):
    path = str(tmp_path / "out")
    done = H.publish(rows_of(spark, (1, DAY1, 5), (2, DAY2, 6)), path, "day", **AUDIT)
    H.verify(spark, done, **AUDIT)
    other = H.publish(rows_of(spark, (1, DAY1, 50), (2, DAY2, 6)), str(tmp_path / "other"), "day", **AUDIT)
    part = glob.glob(f"{path}/{H.DAY}={DAY1}/part-*")[0]
    # rows of another run, then a file that is gone
    shutil.copy(glob.glob(f"{tmp_path}/other/{H.DAY}={DAY1}/part-*")[0], part)
    for crc in glob.glob(f"{path}/{H.DAY}={DAY1}/.*.crc"):
        os.remove(crc)
    with pytest.raises(H.AuditError, match="checksum"):
        H.verify(spark, done, **AUDIT)
    shutil.copy(glob.glob(f"{tmp_path}/other/{H.DAY}={DAY2}/part-*")[0], f"{path}/{H.DAY}={DAY2}/part-more.parquet")
    with pytest.raises(H.AuditError, match="n of 1"):
        H.verify(spark, done, **AUDIT)
    H.verify(spark, other, **AUDIT)


def test_nothing_to_publish(spark, tmp_path):
    done = H.publish(rows_of(spark).where("FALSE"), str(tmp_path / "out"), "day", days=(DAY1, DAY2), **AUDIT)
    assert back(spark, done) == [] and done.metrics["rows"] == 0


# ---- rides in buckets ------------------------------------------------------------


def test_bucketed_rides_are_not_shuffled(spark, t, tmp_path):
    B.store_rides(t, str(tmp_path), 8, hot_rides=10**6)
    for name in ("general_funnel", "segmented_funnel", "segmented_funnel_alt"):
        df = _with_conf(spark, {**NO_BROADCAST, "spark.sql.shuffle.partitions": "8"}, lambda: PLANS[name](B.with_stored_rides(t, str(tmp_path), 8)))  # noqa: B023
        plan = _with_conf(spark, {**NO_BROADCAST, "spark.sql.shuffle.partitions": "8"}, lambda: (df.collect(), plan_of(df).split("Initial Plan")[0])[1])  # noqa: B023
        lines = plan.splitlines()
        joins = [k for k, ln in enumerate(lines) if "SortMergeJoin [user_id" in ln and "Inner" in ln]
        scans = [k for k, ln in enumerate(lines) if "SelectedBucketsCount: 8 out of 8" in ln]
        assert len(scans) == 1
        # between the bucketed scan and the join that reads it there is no exchange
        above = [k for k in joins if k < scans[0]][-1]
        depth = lambda k: len(lines[k]) - len(lines[k].lstrip(" :+-*"))  # noqa: E731, B023
        chain, at = [], depth(scans[0]) + 1
        for k in range(scans[0], above - 1, -1):
            if depth(k) < at:
                chain.append(lines[k])
                at = depth(k)
        assert "SortMergeJoin" in chain[-1] and not any("Exchange" in ln for ln in chain)
        assert sorted(map(repr, df.collect())) == sorted(map(repr, PLANS[name](t).collect()))


def test_a_hot_user_is_not_in_a_bucket_and_its_join_is_split(spark, tmp_path):
    hot = hot_user_tables(spark, "/root/testdata/sf0.01")
    B.store_rides(hot, str(tmp_path), 4, hot_rides=500)
    rides = B.with_stored_rides(hot, str(tmp_path), 4)
    cold, beside = rides.ride_parts
    assert beside.where("user_id = 1000001").count() > 3000 and cold.where("user_id = 1000001").count() == 0
    assert cold.count() + beside.count() == hot.ride_requests.count()

    def run():
        spread = B.BucketedTables(rides.app_downloads, rides.signups, rides.ride_requests, rides.transactions, rides.reviews, facts=(cold, beside.repartition(8)))
        df = dashboard_rows(spread)
        rows = sorted(map(repr, df.collect()))
        return rows, plan_of(df).split("Initial Plan")[0]

    rows, plan = _with_conf(spark, SKEW_CONF, run)
    assert "SortMergeJoin(skew=true) [user_id" in plan
    assert rows == sorted(map(repr, dashboard_rows(hot).collect()))


# ---- folders by day ---------------------------------------------------------------


@pytest.fixture(scope="module")
def by_day(spark, t, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("days"))
    D.store_by_day(t, base)
    return D.read_by_day(spark, base)


def test_a_range_of_days_prunes_folders(t, by_day):
    first, last = datetime.date(2021, 3, 1), datetime.date(2021, 3, 20)
    df = dashboard_rows(by_day.downloaded(first, last), shared=False)
    got = sorted(map(repr, df.collect()))
    scans = [ln for ln in plan_of(df).splitlines() if "app_downloads.parquet" in ln]
    assert scans and all("PartitionFilters: [isnotnull(download_day" in ln and "2021-03-01" in ln for ln in scans)
    assert got == sorted(map(repr, dashboard_rows(D.downloaded(t, first, last)).collect())) and got


def test_days_found_at_run_time_prune_folders(by_day):
    df = stored.busiest_by_hour(by_day, 3)
    rows = df.collect()
    assert len({r["request_day"] for r in rows}) == 3
    assert "dynamicpruningexpression(request_day" in plan_of(df)


def test_a_bloom_filter_of_reached_users_meets_the_ride_scan(spark, t, by_day):
    conf = {**NO_BROADCAST, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"}
    few = D.downloaded(t, datetime.date(2021, 3, 1), datetime.date(2021, 3, 5))

    def run():
        df = dashboard_rows(few, shared=False)
        return sorted(map(repr, df.collect())), plan_of(df).split("Initial Plan")[0]

    rows, plan = _with_conf(spark, conf, run)
    lines = plan.splitlines()
    assert any("might_contain" in ln and "user_id" in ln for ln in lines)
    assert rows == sorted(map(repr, dashboard_rows(few).collect()))


# ---- one shared join ---------------------------------------------------------------


@pytest.mark.parametrize("name", ["general_funnel", "segmented_funnel", "segmented_funnel_alt", "age_funnel_counts"])
def test_downloads_meet_signups_once(spark, t, name):
    def run():
        df = PLANS[name](t)
        df.collect()
        return plan_of(df).split("Initial Plan")[0]

    plan = _with_conf(spark, NO_BROADCAST, run)
    assert sum("SortMergeJoin" in ln and "[app_download_key" in ln and "Inner" in ln for ln in plan.splitlines()) == 1
    assert "ReusedExchange" in plan


# ---- typed ids -----------------------------------------------------------------------


def test_population_of_typed_ids_scans_each_table_once(t):
    plan = plan_of(PLANS["step_share_of_total"](t))
    for name in ("app_downloads", "signups", "ride_requests", "reviews"):
        assert plan.count(f"{name}.parquet") == 1


def test_ids_of_both_types_meet_where_their_texts_are_equal(spark):
    texts = ["5", "05", "+5", "x", None, "7", "9223372036854775808", "-3", " 5", "5.0", ""]
    numbers = [5, 7, 7, None, -3, 11]
    empty = lambda kind: spark.createDataFrame([], kind)
    tables = FunnelTables(
        spark.createDataFrame([(x, "ios", None) for x in texts], "app_download_key string, platform string, download_ts timestamp_ntz"),
        spark.createDataFrame([(1, "7")], "user_id long, session_id string"),
        spark.createDataFrame([(x, None) for x in numbers], "user_id long, dropoff_ts timestamp_ntz"),
        empty("ride_id long"),
        spark.createDataFrame([(None, 11), (None, 12)], "ride_id long, user_id long"),
    )
    ids = [("app_downloads", "app_download_key"), ("signups", "session_id"), ("ride_requests", "user_id"), ("reviews", "user_id")]
    got = {r["step"]: r["count"] for r in shares_of_ids(tables, USER_FUNNEL, ids).collect()}
    assert got == {"App_Downloads": 10, "Sign_Ups": 1, "Ride_Requests": 4, "Completed_Rides": 0, "Reviews": 2}
    pooled = {x for x in texts if x is not None} | {"7"} | {str(x) for x in numbers if x is not None} | {"11", "12"}
    assert distinct_population([(tables[a], c) for a, c in ids]).first()[0] == len(pooled)
    share = {r["step"]: float(r["percentage_share"]) for r in shares_of_ids(tables, USER_FUNNEL, ids).collect()}
    assert share["App_Downloads"] == round(10 / len(pooled) * 100, 2)


# ---- bitmaps ---------------------------------------------------------------------------


def test_dense_ids_keep_their_numbers(spark, tmp_path):
    store = IdStore(spark, str(tmp_path / "ids"))
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long")
    first = {r["id"]: r["dense"] for r in store.extend(frame([9, 5, 5, None, -2])).collect()}
    assert first == {-2: 1, 5: 2, 9: 3}
    later = {r["id"]: r["dense"] for r in store.extend(frame([5, 100, 7, 1])).collect()}
    assert later == first | {1: 4, 7: 5, 100: 6}
    assert store.extend(frame([])).count() == 6


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_days_merge_to_the_full_count(spark, tmp_path, seed):
    """Random splits of days, users who return on later days, a day that is run again, ids in several buckets."""
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), r.choice([1, 2, 40_000, 70_000, 70_001, 99]), datetime.date(2024, 1, r.randint(1, 9))) for _ in range(120)]
    frame = lambda rows: spark.createDataFrame(rows, "seg string, dense long, day date")
    state = DailyBitmaps(spark, str(tmp_path), ("seg",))
    cuts = sorted(r.sample(range(1, 9), 2)) + [9]
    since = 1
    for cut in cuts:
        batch = [x for x in rows if since <= x[2].day <= cut]
        state.add(frame(batch))
        state.add(frame(batch))  # again: nothing is counted twice
        got = {tuple(x) for x in members(state.total(f"2024-01-{cut:02}"), ["seg"]).collect()}
        seen = [x for x in rows if x[2].day <= cut]
        assert got == {(s, len({d for q, d, _ in seen if q == s})) for s in {x[0] for x in seen}}
        since = cut + 1
    few = [x for x in rows if 3 <= x[2].day <= 6]
    assert {tuple(x) for x in state.counts("2024-01-03", "2024-01-06").collect()} == {(s, len({d for q, d, _ in few if q == s})) for s in {x[0] for x in few}}
    # a day that changes: the totals from it on are dropped and made anew
    changed = [x for x in rows if x[2].day != 2] + [("c", 5, datetime.date(2024, 1, 2))]
    state.add(frame([("c", 5, datetime.date(2024, 1, 2))]))
    state.forget("2024-01-02")
    got = {tuple(x) for x in members(state.total("2024-01-09"), ["seg"]).collect()}
    assert got == {(s, len({d for q, d, _ in changed if q == s})) for s in {x[0] for x in changed}}


def test_rollup_counts_a_member_of_two_segments_once(spark):
    rows = spark.createDataFrame([("ios", "a", 1), ("ios", "b", 1), ("ios", "b", 2), ("web", "a", 1)], "platform string, age string, dense long")
    maps = bitmaps(rows, ["platform", "age"])
    assert {tuple(r) for r in members(merged([maps, maps], ["platform"]), ["platform"]).collect()} == {("ios", 2), ("web", 1)}
    assert members(merged([maps], []), []).collect()[0][0] == 2
