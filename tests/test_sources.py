import pytest
from pyspark.sql import functions as F

from stagewise.sources import SCHEMAS, derive_tables, load_tables, read_tables, write_tables

# FIXTURES.md, "Expected values"
EXPECTED_ROWS = {
    "/root/testdata/sf0.001": {"app_downloads": 150, "signups": 113, "ride_requests": 938, "transactions": 458, "reviews": 414},
    "/root/testdata/sf0.01": {"app_downloads": 1500, "signups": 1125, "ride_requests": 9166, "transactions": 4654, "reviews": 4125},
}


@pytest.mark.parametrize("sf_dir", sorted(EXPECTED_ROWS))
def test_derived_row_counts(spark, sf_dir):
    t = derive_tables(spark, sf_dir)
    assert {n: df.count() for n, df in t.items()} == EXPECTED_ROWS[sf_dir]


def test_derived_schemas(spark):
    t = derive_tables(spark, "/root/testdata/sf0.001")
    for name, df in t.items():
        assert [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in SCHEMAS[name].fields]


def test_derived_details_sf001(spark):
    t = derive_tables(spark, "/root/testdata/sf0.001")
    rr = t.ride_requests
    row = rr.agg(
        F.count_distinct("user_id").alias("req"),
        F.count("accept_ts").alias("acc"),
        F.count("dropoff_ts").alias("done"),
        F.sum(F.col("cancel_ts").isNull().cast("int")).alias("open"),
    ).first()
    assert (row.req, row.acc, row.done, row.open) == (92, 840, 458, 501)
    assert t.reviews.where("ride_id IS NULL").count() == 76


def test_write_read_roundtrip_and_load(spark, tmp_path):
    t = derive_tables(spark, "/root/testdata/sf0.001")
    write_tables(t, str(tmp_path))
    back = read_tables(spark, str(tmp_path))
    for name, df in t.items():
        assert sorted(map(repr, df.collect())) == sorted(map(repr, back[name].collect()))
    # a folder with the five tables is read, a driver folder is derived
    assert load_tables(spark, str(tmp_path)).signups.count() == 113
    assert load_tables(spark, "/root/testdata/sf0.001").signups.count() == 113
