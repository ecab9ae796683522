import os

from pyspark.sql import functions as F

from stagewise.plans.queries import PLANS
from stagewise.sources import derive_tables, write_dashboard_dataset


def test_dashboard_dataset_roundtrip(spark, tmp_path):
    df = PLANS["segmented_funnel"](derive_tables(spark, "/root/testdata/sf0.001"))
    out = str(tmp_path / "dash")
    write_dashboard_dataset(df, out)
    assert sorted(d for d in os.listdir(out) if d.startswith("funnel_step=")) == [f"funnel_step={i}" for i in range(1, 8)]
    back = spark.read.parquet(out).select(*df.columns).withColumn("funnel_step", F.col("funnel_step").cast("int"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_entry_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["funnel_step", "funnel_name", "platform", "age_range", "download_date", "user_count", "ride_count"]
    assert df.count() == 646  # FIXTURES.md: Q32 rows at sf0.001
    assert set(PLANS) <= set(entry.queries()) and set(PLANS) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert len(PLANS) == 33


def test_materialize_under_checkpoint_dir(spark):
    from stagewise.session import ensure_checkpoint_dir
    from stagewise.sources import materialize_tables

    tables, dest = materialize_tables(spark, "/root/testdata/sf0.001")
    assert dest.startswith(ensure_checkpoint_dir(spark).rstrip("/"))
    assert tables.ride_requests.count() == 938
