"""Plan shape: the rewrites keep their promises."""

import pytest

from stagewise.plans.queries import PLANS
from stagewise.sources import read_tables, write_tables, derive_tables


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    write_tables(derive_tables(spark, "/root/testdata/sf0.001"), path)
    return read_tables(spark, path)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["general_funnel", "segmented_funnel", "segmented_funnel_alt", "age_funnel_counts", "age_funnel_conversion",
     "platform_scorecard", "funnel_step_conversion"],
)
def test_no_expand(t, name):
    assert "Expand" not in plan_of(PLANS[name](t))


def test_each_table_scanned_once_per_stage_group(t):
    """Stages reading the same table share one scan (Q11: one ride_requests scan)."""
    plan = plan_of(PLANS["funnel_step_conversion"](t))
    assert plan.count("ride_requests.parquet") == 1


def test_segmented_funnel_steps_share_one_aggregate(t):
    df = PLANS["segmented_funnel"](t)
    df.collect()
    plan = plan_of(df).split("Initial Plan")[0]
    # ride_requests is read once
    assert plan.count("ride_requests.parquet") <= 2
    # keying generators: matched and unmatched downloads, ride rows; unpivot
    # generators: download+signup steps, ride steps. No per-step branches.
    assert plan.count("Generate inline") == 5


def test_filters_pushed_to_scan(t):
    plan = plan_of(PLANS["payments_collected"](t))
    assert "PushedFilters: [IsNotNull(charge_status), EqualTo(charge_status,Approved)]" in plan
    assert "ReadSchema: struct<ride_id:bigint,purchase_amount_usd:double,charge_status:string>" in plan


def test_column_pruning(t):
    plan = plan_of(PLANS["requests_by_hour"](t))
    assert "ReadSchema: struct<request_ts:timestamp_ntz>" in plan


def test_reviews_reduced_before_join(t):
    """R1: reviews reach the age funnel only as distinct users."""
    plan = plan_of(PLANS["age_funnel_counts"](t))
    reviews_scan = [line for line in plan.splitlines() if "reviews.parquet" in line]
    assert reviews_scan and all("ReadSchema: struct<user_id:bigint>" in line for line in reviews_scan)


def test_no_distinct_union_aggregate(t):
    """Step counts are unioned with UNION ALL: no aggregate over the step rows."""
    plan = plan_of(PLANS["funnel_lowest_conversion"](t))
    assert "keys=[step" not in plan


SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def _with_conf(spark, conf, fn):
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return fn()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.mark.parametrize(
    "name",
    ["general_funnel", "segmented_funnel", "segmented_funnel_alt", "age_funnel_counts", "age_funnel_conversion", "ride_requests_by_platform", "platform_scorecard"],
)
def test_hot_session_join_is_split(spark, name):
    """A third of the signups on one session id: the download-signup join is
    an inner join (plus an anti join on distinct sessions), so adaptive
    execution can split the hot session's partition. The partition is small
    here, hence the small advisory size."""
    from conftest import SF_MID, hot_session_tables

    def run():
        df = PLANS[name](hot_session_tables(spark, SF_MID))
        df.collect()
        return plan_of(df).split("Initial Plan")[0]

    conf = {**SKEW_CONF, "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.shuffle.partitions": "16"}
    plan = _with_conf(spark, conf, run)
    assert "SortMergeJoin(skew=true) [app_download_key" in plan
    inner = [ln for ln in plan.splitlines() if "SortMergeJoin" in ln and "[app_download_key" in ln and "Inner" in ln]
    assert inner and all("skew=true" in ln for ln in inner)


@pytest.mark.parametrize("name", ["general_funnel", "segmented_funnel", "segmented_funnel_alt"])
def test_hot_user_join_is_split(spark, name):
    """With one user owning a third of the rides, adaptive execution splits the
    skewed partition of the ride-to-user join (the aggregation after it
    shuffles on its own keys, so splitting adds no exchange)."""
    from conftest import SF_MID, hot_user_tables

    def run():
        df = PLANS[name](hot_user_tables(spark, SF_MID))
        df.collect()
        return plan_of(df).split("Initial Plan")[0]

    assert "SortMergeJoin(skew=true) [user_id" in _with_conf(spark, SKEW_CONF, run)
