"""Every registered query of the library proper against its SQL on the smallest tables, and the entry point."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from accordis import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "None" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_agrees_with_its_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in plans.SQL:
        return
    found = duck.execute(plans.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(tuple(plain(v) for v in r) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
