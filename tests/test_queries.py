"""Every registered query against its SQL counterpart, and the shape of the plans."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from eventlink.plans import catalogue, oracle
from eventlink.plans.catalogue import _QUERIES
from eventlink.plans.proxy import Views

FOLDER = contract.SMOKE_FOLDER
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, SQL = catalogue.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    yield con
    con.close()


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    number = float(value)
    return None if math.isnan(number) else round(number, 5)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    found = [tuple(map(plain, r)) for r in frame.select(*columns).collect()]
    result = duck.execute(SQL[name])
    theirs = [c[0] for c in result.description]
    assert sorted(theirs) == columns
    order = [theirs.index(c) for c in columns]
    wanted = [tuple(plain(r[i]) for i in order) for r in result.fetchall()]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "Python" not in text


def test_filters_reach_the_scan(spark):
    text = _QUERIES["link_causes"](Views(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type, [click,purchase,signup])" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in text


def test_flagship(spark):
    assert contract.entry(spark).count() > 0
