"""Products by packed codes: against plain sums, over more tiles, blocks and parts than the small tables have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.operators import markers, relatedness


def plain(code, v):
    x = np.where(code < 0, np.nan, np.take_along_axis(np.column_stack([v, np.full(len(v), np.nan)]).T, np.where(code < 0, v.shape[1], code), axis=0))
    have = ~np.isnan(x)
    return have.astype(int) @ have.T.astype(int), np.nan_to_num(x) @ np.nan_to_num(x).T


@pytest.mark.parametrize("size", [3, 7, 20])
@pytest.mark.parametrize("small", [True, False])
def test_products_of_codes(spark, monkeypatch, size, small):
    if not small:  # tiles, blocks and parts of a few rows
        monkeypatch.setattr(relatedness, "TILE", 8)
        monkeypatch.setattr(relatedness, "MARKERS", 16)
        monkeypatch.setattr(relatedness, "HELD", 2)
        monkeypatch.setattr(relatedness, "SMALL", 16)
        monkeypatch.setattr(relatedness, "LARGE", 16)
    rng = np.random.default_rng(size)
    n, m = 37, 70
    code = rng.integers(-1, size, (n, m))
    code[5, 3:] = -1  # an individual with few cells
    v = rng.normal(size=(m, size))
    v[9, 1] = np.nan
    cells = [(i, j, int(code[i, j]) if code[i, j] >= 0 else None) for i in range(n) for j in range(m)]
    values = [(j, [None if np.isnan(y) else float(y) for y in v[j]]) for j in range(m) if j != 11]  # a marker without numbers
    v[11] = np.nan
    d = relatedness.coded_products(spark.createDataFrame(cells, "iid long, sid long, code int").repartition(5), spark.createDataFrame(values, "sid long, v array<double>"), size)
    got = {(r.i, r.j): (r.n, r.s) for r in d.collect()}
    count, s = plain(code, v)
    assert set(got) == {(i, j) for i in range(n) for j in range(i + 1) if count[i, j]}
    assert all(k == count[p] and x == pytest.approx(s[p]) for p, (k, x) in got.items())


def test_a_code_without_a_number_is_an_error(spark):
    cells, values = spark.createDataFrame([(0, 0, 3)], "iid long, sid long, code int"), spark.createDataFrame([(0, [0.0, 1.0, 2.0])], "sid long, v array<double>")
    with pytest.raises(Exception, match="a code without a number"):
        relatedness.coded_products(cells, values, 3).collect()


def test_a_marker_is_not_shuffled_by_cell(spark, sf_dir):
    """Cells are packed where they are read, without a join or a window by their marker."""
    from lociflow.plans.fixture import fixture

    f = fixture(spark, sf_dir)
    for d in (relatedness.grm(f.g), relatedness.grm_x(f.g, f.ind), relatedness.grm_within(f.g, f.ind)):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan
        joined = [line for line in plan.splitlines() if "Join" in line and "sid" in line]
        assert not joined, joined


def test_within_populations_as_by_window(spark):
    rng = np.random.default_rng(3)
    g = [(i, j, int(x) if x < 3 else None) for (i, j), x in np.ndenumerate(rng.integers(0, 4, (24, 30)))]
    g = spark.createDataFrame(g, "iid long, sid long, gt int")
    ind = spark.createDataFrame([(i, None if i % 5 == 4 else i % 5) for i in range(24)], "iid long, pop int")
    one = relatedness.grm_within(g, ind)
    two = relatedness.from_standardised(markers.standardise_within(g, ind))
    a, b = ({(r.i, r.j): (r.n, r.value) for r in d.collect()} for d in (one, two))
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1]) for k in a)


def test_top_percentile(spark):
    from lociflow.plans.catalog import top_percentile

    x = np.random.default_rng(4).normal(size=301)
    d = spark.createDataFrame([(float(v),) for v in x], "value double")
    for p in (0.5, 0.97, 0.991, 1.0):
        assert top_percentile(d, p) == pytest.approx(d.agg(F.percentile("value", p)).first()[0], abs=1e-15)


@pytest.mark.parametrize("algorithm", [1, 2, 3])
def test_expression_matrices_join_no_pairs(spark, monkeypatch, algorithm):
    """One product of pairs gives all of a matrix: a join of two could be planned as a broadcast of all pairs."""
    made = []
    real = relatedness.pair_products
    monkeypatch.setattr(relatedness, "pair_products", lambda *a, **k: made.append(1) or real(*a, **k))
    rng = np.random.default_rng(algorithm)
    x = rng.normal(size=(9, 12))
    x[2, 3] = x[4, 5] = np.nan
    p = spark.createDataFrame([(i + 508, j, float(v)) for (i, j), v in np.ndenumerate(x) if not np.isnan(v)], "iid long, probe int, val double")
    d = relatedness.erm(p, algorithm)
    assert len(made) == 1
    assert d._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") <= 2
    have = ~np.isnan(x)
    if algorithm == 3:
        c = np.nan_to_num(x - np.nanmean(x, axis=1, keepdims=True))
        a = c @ c.T / np.sqrt(np.outer((c * c).sum(1), (c * c).sum(1)))
    else:
        v = np.nanvar(x, axis=0, ddof=1)
        c = np.nan_to_num(x - np.nanmean(x, axis=0))
        a = (c / np.sqrt(v)) @ (c / np.sqrt(v)).T / (have.astype(int) @ have.T) if algorithm == 1 else c @ c.T / ((have * v) @ have.T)
    a /= np.diag(a).mean()
    got = {(r.i - 508, r.j - 508): r.value for r in d.collect()}
    assert len(got) == 45 and all(y == pytest.approx(a[k]) for k, y in got.items())
