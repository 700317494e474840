"""Every registered query against its SQL on the small tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    message, _, _ = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF)
    assert message == ""


def test_entry(spark):
    assert entry(spark).count() == 1000


def test_stationary_hysteresis_where_values_meet_thresholds(spark, tmp_path):
    """Values on a grid meet the widened thresholds but for the last bit, so SQL and query have to interpolate alike."""
    import duckdb
    from reelframe.catalogue import QUERIES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(
        f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * i AS ts, CAST(hash(i * 7) % 600 AS BIGINT) AS user_id, 'view' AS event_type,
        round((hash(i * 13 + 1) % 400) / 10.0, 1)::DOUBLE AS value, '{{"k": ' || (hash(i * 17 + 5) % 60 + 20) || '}}' AS props FROM range(20000) t(i))
        TO '{tmp_path}/events.parquet' (FORMAT parquet)"""
    )
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    q = QUERIES["stationary_hysteresis"]
    assert compare(spark, con, q.name, q.run, q.check_sql(), str(tmp_path))[0] == ""
