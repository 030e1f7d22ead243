import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = sorted(n for n in entry.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return db


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) else v if isinstance(v, bool) else int(v) if isinstance(v, int) else str(v)
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, result.fetchall())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_name_and_runs_lazily():
    assert len(entry.queries()) >= 80 and set(entry.oracle_sql()) <= set(entry.queries())
