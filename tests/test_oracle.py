"""Every query against its DuckDB oracle (naive reference shape).

On the driver's data at sf0.001 (derived tables, derivation checked too) and
on the edge fixture and its variants (empty tables, a growing step,
duplicate signups / rides / transactions, unparsable ages, NULL times).
"""

import pytest
from compare import canonical, duck_type, duckdb_connection

from stagewise.plans.oracle import oracle_statements
from stagewise.plans.queries import PLANS
from stagewise.sources.tables import read_tables

NAMES = sorted(PLANS)
VARIANTS = ["base", "empty", "growing", "duplicates", "hot_user", "hot_session", "random1", "random2", "random3"]


@pytest.fixture(scope="module")
def driver_run(spark):
    import __spark_entry__ as entry

    return entry.queries(), entry.oracle_sql(), duckdb_connection("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", NAMES)
def test_driver_data_sf0001(spark, driver_run, name):
    qs, sql, con = driver_run
    df = qs[name](spark, "/root/testdata/sf0.001")
    cur = con.execute(sql[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    types = dict(zip(cols, [str(c[1]) for c in cur.description]))
    assert {c: duck_type(t) for c, t in df.dtypes} == types
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(cols, cur.fetchall())


@pytest.fixture(scope="module")
def edge_cons(spark, edge_dir):
    import duckdb

    out = {}
    for variant in VARIANTS:
        con = duckdb.connect()
        for name in ("app_downloads", "signups", "ride_requests", "transactions", "reviews"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{edge_dir / variant / name}.parquet/*.parquet')")
        out[variant] = (con, read_tables(spark, str(edge_dir / variant)))
    return out


@pytest.mark.parametrize("variant", VARIANTS)
@pytest.mark.parametrize("name", NAMES)
def test_edge_variants(edge_cons, variant, name):
    con, tables = edge_cons[variant]
    df = PLANS[name](tables)
    cur = con.execute(oracle_statements(None)[name])
    cols = [c[0] for c in cur.description]
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(cols, cur.fetchall())
