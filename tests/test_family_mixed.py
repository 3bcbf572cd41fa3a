"""Mixed models by families against dense matrices of all individuals."""

import numpy as np
import pandas as pd
import pytest

from lociflow.operators import family_mixed as fm
from lociflow.operators import variance
from lociflow.operators.association import linear_scan
from lociflow.plans.storage import keep

N, M = 80, 50


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(8)
    family = np.concatenate([np.repeat(np.arange(15), 4), np.arange(100, 120)])
    a = np.where(family[:, None] == family[None, :], 0.5, 0.0)
    np.fill_diagonal(a, 1 + rng.normal(size=N) * 0.02)
    a[3, 4] = a[4, 3] = 0.1  # one relative joins two families
    x = rng.binomial(2, 0.3, size=(M, N)).astype(float)
    x[rng.random((M, N)) < 0.05] = np.nan
    x[5] = 1
    y = 1.2 * np.linalg.cholesky(a) @ rng.normal(size=N) + 0.6 * rng.normal(size=N)
    ids = np.arange(N) * 3 + 7
    i, j = np.nonzero(np.tril(a))
    rows = pd.DataFrame({"i": ids[j], "j": ids[i], "value": a[i, j]})  # the other triangle
    ad = spark.createDataFrame(pd.concat([rows, pd.DataFrame({"i": [9001], "j": [9001], "value": [1.0]})]))  # no phenotype
    yd = spark.createDataFrame([(int(i), float(v)) for i, v in zip(ids, y)] + [(9002, 3.0), (9003, None)], "iid long, y double")
    g = spark.createDataFrame([(int(ids[k]), s, None if np.isnan(x[s, k]) else int(x[s, k])) for s in range(M) for k in range(N)], "iid long, sid long, gt int")
    return a, x, y, ids, g, keep(fm.family_entries(ad, yd, keep))


def test_families(made):
    a, _, _, ids, _, entries = made
    got = {r.i: r.family for r in entries.where("i = j").collect()}
    assert got == {int(ids[k]): int(ids[f[0]]) for f in variance.detect_families(a) for k in f}


def test_fit_and_its_error(made):
    a, _, y, _, _, entries = made
    got = fm.fit(entries, keep)
    vg, ve, logl = variance.sparse_reml(y, a)
    assert (got.vg, got.ve, got.logl) == pytest.approx((vg, ve, logl), rel=1e-6)
    v = np.linalg.inv(vg * a + ve * np.eye(N))
    one = v.sum(axis=1)
    p = v - np.outer(one, one) / one.sum()
    parts = [a @ p @ (y - y.mean()), p @ (y - y.mean())]
    info = 0.5 * np.array([[u @ p @ w for w in parts] for u in parts])
    assert got.variance == pytest.approx(np.linalg.inv(info)[0, 0], rel=1e-4)


def test_null_model():
    assert fm.null_model(fm.FamilyFit(0.1, 0.9, 0, 1.0)) is None
    assert fm.null_model(fm.FamilyFit(0.1, 0.9, 0, 1.0), force=True).vg == 0.1
    assert fm.null_model(fm.FamilyFit(0.5, 0.5, 0, 0.01)).vg == 0.5
    assert fm.null_model(fm.FamilyFit(1.2, -0.2, 0, 0.01)).vg == pytest.approx(0.99)
    assert fm.null_model(fm.FamilyFit(1.2, -0.2, 0, 0.01), constrain=False).vg == 1.2


def test_scans(made):
    a, x, y, _, g, entries = made
    vi = keep(fm.inverse(entries, 0.7, 0.4))
    v = np.linalg.inv(0.7 * a + 0.4 * np.eye(N))
    xc = np.nan_to_num(x - np.nanmean(x, axis=1, keepdims=True))
    xvx, xvy, xx = ((xc @ v) * xc).sum(1), xc @ v @ (y - y.mean()), (xc * xc).sum(1)
    for pieces in (2**23, 40):  # all entries at once, and a few
        got = fm.scan_exact(g, vi, keep, pieces).orderBy("sid").toPandas()
        assert list(got.sid) == [s for s in range(M) if s != 5]  # a marker that doesn't vary has no row
        assert got.b.to_numpy() == pytest.approx((xvy / np.where(xvx > 0, xvx, 1))[got.sid], rel=1e-9)
        assert got.se.to_numpy() == pytest.approx(xvx[got.sid] ** -0.5, rel=1e-9)
    small = [s for s in range(M) if s != 5 and xvy[s] ** 2 / xvx[s] < 5]
    ratio = fm.gamma(g, vi, keep)
    assert ratio == pytest.approx(np.mean(xvx[small] / xx[small]), rel=1e-9)
    got = fm.scan_approximate(g, vi, ratio, keep).orderBy("sid").toPandas()
    assert got.b.to_numpy() == pytest.approx(xvy[got.sid] / ratio / xx[got.sid], rel=1e-9)


def test_the_whole_scan(spark, made, monkeypatch):
    a, _, y, ids, g, entries = made
    i, j = np.nonzero(np.tril(a))
    ad = spark.createDataFrame(pd.DataFrame({"i": ids[i], "j": ids[j], "value": a[i, j]}))
    yd = spark.createDataFrame([(int(i), float(v)) for i, v in zip(ids, y)], "iid long, y double")
    for share, scan in ((0.5, "mixed"), (0.5, "approximate"), (0.0, "linear")):
        vp = float(np.var(y, ddof=1))
        monkeypatch.setattr(fm, "fit", lambda *_: fm.FamilyFit(share * vp, (1 - share) * vp, 0.0, 1e-4 if share else 1.0))
        got = {r.sid: r.b for r in fm.family_scan(g, ad, yd, keep, approximate=scan == "approximate").collect()}
        vi = keep(fm.inverse(entries, 0.5 * vp, 0.5 * vp))
        want = {"mixed": lambda: fm.scan_exact(g, vi, keep), "approximate": lambda: fm.scan_approximate(g, vi, fm.gamma(g, vi, keep), keep), "linear": lambda: linear_scan(g, yd)}[scan]()
        assert got == pytest.approx({r.sid: r.b for r in want.collect()}, rel=1e-6)


def test_monte_carlo_reml(spark):
    rng = np.random.default_rng(4)
    n, m = 300, 400
    x = rng.binomial(2, rng.uniform(0.1, 0.5, size=(m, 1)), size=(m, n)).astype(float)
    mu = x.mean(axis=1, keepdims=True)
    z = (x - mu) / np.sqrt(mu * (1 - mu / 2))
    y = z.T @ rng.normal(size=m) / np.sqrt(m) * np.sqrt(0.6) + rng.normal(size=n) * np.sqrt(0.4)
    a = z.T @ z / m
    i, j = np.tril_indices(n)
    ad = spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "value": a[i, j]}))
    yd = spark.createDataFrame(pd.DataFrame({"iid": np.arange(n), "y": y}))
    s, k = np.indices((m, n))
    g = spark.createDataFrame(pd.DataFrame({"iid": k.ravel(), "sid": s.ravel(), "gt": x.astype(int).ravel()}))
    entries = keep(fm.family_entries(ad, yd, keep))
    got = fm.monte_carlo(g, entries, keep)
    assert got == pytest.approx(variance.reml(y, np.ones((n, 1)), [a]).theta[0], rel=0.35)
    assert fm.monte_carlo(g, entries, keep) == pytest.approx(got, rel=1e-9)
