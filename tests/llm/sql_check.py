"""Compares a registered query with its SQL on a folder of tables."""

import duckdb


def same(spark, name, sf_dir):
    from stagewise.llm.queries import ORACLE_SQL, QUERIES

    got = QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted(map(tuple, got.select(*names).collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)
    return len(rows)
