"""Every query with SQL gives the rows of its SQL at the smallest scale."""

import math
import os

import pytest

from lumenframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return f"{v + 0.0:.7g}"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted([cell(r[names.index(c)]) for c in cols] for r in cur.fetchall())
    got = sorted([cell(r[c]) for c in cols] for r in df.collect())
    assert got == want
