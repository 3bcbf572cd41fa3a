"""Every query with SQL gives the rows that DuckDB gives; the others run and keep their shape."""

import math
import os

import duckdb
import pytest

from lociflow.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 5) + 0.0 if isinstance(v, float) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    c = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, c.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    # ten individuals leave these without two instruments
    df = catalog.QUERIES[name](spark, SF if name not in ("m11_m13_gsmr", "m12_gsmr_traits", "m13_heidi_forms") else "/root/testdata/sf0.01")
    found = df.collect()
    assert found and df.columns
    for c, kind in df.dtypes:  # a column of nothing but nulls would be an operator that gives up
        held = [r[c] for r in found if r[c] is not None]
        assert held, c
        if kind == "double":
            assert any(math.isfinite(v) for v in held), c
        if c == "p" or c.startswith("p_"):
            assert all(math.isnan(v) or 0 <= v <= 1 for v in held), c
        if c.startswith("chi2") or c == "se" or c.startswith("se_"):
            assert all(math.isnan(v) or v > -1e-6 for v in held), c


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
