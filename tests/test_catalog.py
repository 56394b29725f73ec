"""Every query of the engine against its SQL."""

from __future__ import annotations

import duckdb
import pytest
from conftest import same

from chunkloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(name, spark, duck, sf_dir):
    same(catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_has_rows(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("rest", [1, 2, 5, 12, 40])
def test_stride_of_odd_batches(rest, spark, tmp_path):
    """A period beyond the lags of the SQL, batches that don't vary, and a last one of few rows."""
    con = duckdb.connect()
    con.sql(
        f"""COPY (SELECT *, timestamp '2024-01-01' AS ts, 1.0::DOUBLE AS value, 'view' AS event_type FROM (
            SELECT i AS event_id, 1500 * (i % 6) AS user_id FROM range(1000) r(i)
            UNION ALL SELECT 10000 + 5 * i, 7 FROM range(1000) r(i)
            UNION ALL SELECT 20000 + i, NULL FROM range(1000) r(i)
            UNION ALL SELECT 30000 + 5 * i, 1500 * (i % 2) FROM range({rest}) r(i))) TO '{tmp_path}/events.parquet' (FORMAT parquet)"""
    )
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    same(catalog.QUERIES["stride"](spark, str(tmp_path)).toPandas(), con.sql(catalog.ORACLE_SQL["stride"]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
