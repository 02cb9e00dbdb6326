"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from quirework.plans import everything

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, float) and not isinstance(x, bool):
        return f"{x:.9g}"
    if hasattr(x, "as_tuple"):
        return f"{float(x):.9g}"
    if isinstance(x, int) and not isinstance(x, bool):
        return f"{float(x):.9g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(everything.SQL))
def test_equals_sql(spark, duck, name):
    df = everything.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    found = duck.execute(f"select {quoted} from ({everything.SQL[name]})")
    expected = sorted(tuple(map(value, r)) for r in found.fetchall())
    assert sorted(tuple(value(r[c]) for c in columns) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(everything.QUERIES) - set(everything.SQL)))
def test_runs(spark, name):
    assert everything.QUERIES[name](spark, SF).count() > 0


def test_every_name_is_there():
    import __spark_entry__

    assert set(everything.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
