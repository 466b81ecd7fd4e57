"""Registered queries against their DuckDB twins, and the driver contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from sigloom import catalog

SMALL = "/root/testdata/sf0.001"
SAMPLE = "flagship_errors_by_minute token_cs phrase_gap2 min_match2 topk_relevance trace_join_service winner_points traces_view logql_logfmt_filter logql_sum_by logql_group_left detected_fields prom_rate prom_group_left prom_subquery traceql_descendant traceql_by_count traceql_quantile correlation_lookup rollup_counter sql_window stream_tail".split()


def tidy(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v if v is None or isinstance(v, (str, int, bool)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(SMALL):
        con.execute(f"create view {name[:-8]} as select * from '{SMALL}/{name}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_oracle(spark, duck, name):
    query = catalog.QUERIES[name]
    df = query.run(spark, SMALL)
    columns = sorted(df.columns)
    relation = duck.sql(query.sql)
    assert sorted(relation.columns) == columns
    theirs = sorted(([tidy(row[relation.columns.index(c)]) for c in columns] for row in relation.fetchall()), key=str)
    assert sorted(([tidy(r[c]) for c in columns] for r in df.collect()), key=str) == theirs


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150
