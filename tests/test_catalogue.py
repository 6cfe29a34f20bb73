"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from factloom.plans import catalogue, goldens

QUERIES, ORACLES = catalogue.QUERIES | goldens.QUERIES, catalogue.ORACLES | goldens.ORACLES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(names, found):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(r[i] for i in at) for r in found), key=lambda t: [(x is None, str(x)) for x in t])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys() and not catalogue.QUERIES.keys() & goldens.QUERIES.keys()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,42)]" in plan(QUERIES["point_get"](spark, DATA))
    for name in ("find_references", "nearest_ancestor", "alias_expand"):
        assert "NestedLoop" not in plan(QUERIES[name](spark, DATA))
    assert "Window" not in plan(QUERIES["upsert_last_wins"](spark, DATA))
