"""Every query with SQL against DuckDB on the smallest tables (the finder and live jobs have tests of their own)."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
SLOW = {"live_bunches", "live_accounting", "live_cleared", "live_reference", "incomplete_bunches"}
NAMES = sorted(n for n in entry.oracle_sql() if n not in SLOW)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert check.rows(df.columns, df.collect()) == check.rows(cols, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_reference_map_of_runs_without_a_phase(spark, folder):
    """A run with one trigger, or none, has no phases: its hits have no bin, on either axis."""
    c = duckdb.connect()
    c.execute(
        f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i * 700000123) + to_days(CAST(i // 40 * 14 AS INT)) AS ts,
        CASE WHEN i % 40 = 7 AND i < 80 OR i < 40 AND i % 5 = 0 THEN 5 ELSE 10 + i % 30 END AS user_id, 'view' AS event_type, i * 3.7 AS value, '{{"k": 7}}' AS props
        FROM range(120) t(i)) TO '{folder}/events.parquet'"""
    )
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = c.execute(entry.oracle_sql()["rf_map"]).fetchall()
    assert sum(r[1] is None for r in want) and sum(r[1] is not None for r in want)
    df = entry.queries()["rf_map"](spark, folder)
    assert check.rows(df.columns, df.collect()) == check.rows(["plane", "tof_bin", "q_bin", "n"], want)
