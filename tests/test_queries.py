"""Every registered query runs on the smallest tables and, with a SQL form, agrees with it."""

import os

import pytest

import __spark_entry__ as entry
from gridweave import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", [*catalog.QUERIES])
def test_query(spark, name):
    import duckdb

    from verify import TABLES, norm

    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in catalog.ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        rel = con.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        want = sorted((tuple(norm(dict(zip(names, r, strict=True))[c]) for c in cols) for r in rel.fetchall()), key=repr)
        assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns
