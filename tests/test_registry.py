"""Every registered query gives the rows that its SQL gives on DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from authscope.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.01"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) and not (isinstance(v, float) and math.isnan(v)) else v
    return sorted((tuple(str(clean(r[i])) for i in order) for r in data))


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
