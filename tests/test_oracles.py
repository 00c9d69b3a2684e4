"""Every registered query against its SQL twin on the small tables."""

import os

import duckdb
import pytest

from workload import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def shown(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    columns = sorted(result.columns)
    got = sorted(tuple(map(shown, r)) for r in result.select(*columns).collect())
    spark.catalog.clearCache()
    if name not in ORACLES:
        return
    answer = duck.execute(ORACLES[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(shown(r[i]) for i in order) for r in answer.fetchall())
    assert got == want


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_crawl_jobs_gathers_no_list_of_a_host(spark):
    plan = QUERIES["crawl_jobs"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
