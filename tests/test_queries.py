"""Every registered query with SQL gives DuckDB's rows on the smallest tables; every other one runs."""

import math

import duckdb
import pytest

from tidegrid import plans

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert len(set(cols)) == len(cols)
    if name in SQL:
        rel = con.sql(SQL[name])
        names, rows = rel.columns, rel.fetchall()
        assert sorted(names) == cols
        assert got == ordered(tuple(plain(r[names.index(c)]) for c in cols) for r in rows)


@pytest.mark.parametrize("name", ["validate_candles", "dead_letters"])
def test_candles_of_small_values(spark, tmp_path, name):
    """Larger tables hold values of 0; each must meet every way of breaking a message, and come back as it is."""
    import datetime

    values = [0.0, 0.01, 0.02, 0.03, 0.0123456789, -5.25, None, 29.27, 12.3456789, 1e12]
    rows = [(16 * k + m, datetime.datetime(2024, 1, 1), 1, "view", v, '{"k": 1}') for k, v in enumerate(values) for m in range(16)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    rel = c.sql(SQL[name])
    assert ordered(tuple(r[k] for k in rel.columns) for r in df.collect()) == ordered(rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_optional_subpackage(monkeypatch):
    import importlib.util

    import __spark_entry__ as e

    real = importlib.util.find_spec
    monkeypatch.setattr(e.importlib.util, "find_spec", lambda n, *a: None if n == "tidegrid.llm" else real(n, *a))
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(SQL)


