"""Every query with SQL beside it gives DuckDB's rows on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from dialume.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, datetime.date):
        return str(v)
    return round(float(v), 6) if isinstance(v, float) or not isinstance(v, (str, int)) else v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    values = got.collect()
    if name not in queries.ORACLES:
        assert len(values) > 0
        return
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, values) == rows(names, want.fetchall())


def test_entry_without_session_state():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
