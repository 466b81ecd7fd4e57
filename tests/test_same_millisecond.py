"""PromQL queries against their DuckDB twins on events of which many share a series and a millisecond."""

import duckdb
import pytest

from sigloom import catalog, queries as _registered  # noqa: F401
from tests.test_oracles import tidy

#: Events before, at and after the steps of the queries, several in the millisecond of a step, with ids that do not follow time.
EVENTS = """SELECT (i * 7919) % 3001 AS event_id, make_timestamp(1704153600000000 + (i % 30 - 6) * 21600000000 + [0, 0, 250, 999, 1000, 1400, -1, -700, -3600000000][i // 60 % 9 + 1]) AS ts,
 i * 31 % 2 AS user_id, ['click', 'view'][i // 540 % 2 + 1] AS event_type, i * 37 % 1000 / 100.0::DOUBLE AS value, '{"k": 1}' AS props FROM range(0, 2160) r(i)"""


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    folder = tmp_path_factory.mktemp("crowded")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute(f"copy ({EVENTS}) to '{folder}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["prom_negative_offset", "prom_sum_over_time", "prom_range_offset", "prom_ignoring", "prom_rate", "prom_irate", "prom_changes", "prom_last_over_time"])
def test_samples_of_one_millisecond_all_count(spark, crowded, name):
    folder, con = crowded
    query = catalog.QUERIES[name]
    rows = query.run(spark, str(folder)).select("t", "labels", "value").collect()
    theirs = con.sql(f"SELECT t, labels, value FROM ({query.sql})").fetchall()
    assert sorted(([tidy(v) for v in r] for r in rows), key=str) == sorted(([tidy(v) for v in r] for r in theirs), key=str)
