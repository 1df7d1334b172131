"""Every query of the catalogue against DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from quern import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in catalogue.ORACLES:
        found = duck.execute(catalogue.ORACLES[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(tuple(cell(r[i]) for i in at) for r in found.fetchall())


def test_flagship(spark, sf_dir):
    rows = {r.program_id: r.n for r in catalogue.flagship(spark, sf_dir).collect()}
    assert set(rows) == {"A", "B"} and sum(rows.values()) == 1000
