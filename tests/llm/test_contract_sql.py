"""The contract queries that SQL can express, against their SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from accordis.llm import queries  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(map(str, r)) for r in found.fetchall()) == sorted(tuple(str(r[c]) for c in columns) for r in got.collect())
