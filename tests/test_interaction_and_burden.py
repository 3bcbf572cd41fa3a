"""The grid of interaction components by families against dense likelihoods, and gene score tests from a saved model."""

import numpy as np
import pandas as pd
import pytest

from lociflow.operators import association
from lociflow.operators import family_mixed as fm
from lociflow.plans.storage import keep
from lociflow.sources.text import read_model, write_model


def planted(spark, rho, seed=3, families=150, size=6):
    rng, n = np.random.default_rng(seed), families * size
    a = np.kron(np.eye(families), np.full((size, size), 0.5) + 0.5 * np.eye(size))
    e = rng.normal(size=n)
    z = (e - e.mean()) / e.std(ddof=1)
    k = rho * a + (1 - rho) * a * np.outer(z, z)
    y = 2 + 0.7 * e + np.linalg.cholesky(3 * k + 1e-9 * np.eye(n)) @ rng.normal(size=n) + rng.normal(size=n)
    i, j = np.nonzero(np.tril(a))
    ad = spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "value": a[i, j]}))
    yd = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "iid long, y double")
    ed = spark.createDataFrame([(k, float(v)) for k, v in enumerate(e)], "iid long, e double")
    return a, z, e, y, keep(fm.family_entries(ad, yd, keep)), keep(ed)


def dense_logl(k, y, vg, ve):
    v = vg * k + ve * np.eye(len(y))
    one = np.ones(len(y))
    vi = np.linalg.inv(v)
    xx = one @ vi @ one
    return -0.5 * (np.linalg.slogdet(v)[1] + np.log(xx) + y @ vi @ y - (one @ vi @ y) ** 2 / xx)


@pytest.mark.parametrize("rho", [0.2, 0.8])
def test_planted_share_is_found(spark, rho):
    a, z, e, y, entries, env = planted(spark, rho)
    found, chosen = fm.fit_interaction(entries, env, keep)
    assert abs(found.rho - rho) <= 0.2 and found.vg > found.ve
    left = y - np.polyval(np.polyfit(e, y, 1), e)
    of = lambda r: r * a + (1 - r) * a * np.outer(z, z)
    assert found.logl == pytest.approx(dense_logl(of(found.rho), left, found.vg, found.ve), abs=1e-6)
    vp = found.vg + found.ve
    assert vp == pytest.approx(left @ left / (len(y) - 2))
    for r in (0.0, max(found.rho - 0.1, 0), min(found.rho + 0.1, 1), 1.0):  # no better point on a coarse dense grid
        assert max(dense_logl(of(r), left, v, vp - v) for v in np.linspace(0.02, 0.98, 13) * vp) <= found.logl + 1e-6
    got = {(r.i, r.j): r.value for r in chosen.collect()}
    assert all(got[i, j] == pytest.approx(of(found.rho)[i, j]) for i, j in [(0, 0), (5, 2), (11, 6)])


def test_interaction_scan_by_families(spark):
    a, z, e, y, entries, env = planted(spark, 0.5, families=40)
    n = len(y)
    rng = np.random.default_rng(1)
    x = rng.binomial(2, 0.4, size=(8, n))
    g = spark.createDataFrame([(i, s, int(x[s, i])) for s in range(8) for i in range(n)], "iid long, sid long, gt int")
    found, scan = fm.interaction_family_scan(g, entries, env, keep)
    left = y - np.polyval(np.polyfit(e, y, 1), e)
    k = found.rho * a + (1 - found.rho) * a * np.outer(z, z)
    adjusted = found.ve * np.linalg.solve(found.vg * k + found.ve * np.eye(n), left)
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(adjusted)], "iid long, y double")
    want = {r.sid: r for r in association.interaction_scan(g, frame, env, robust=True).collect()}
    for r in scan.collect():
        assert r.b_ge == pytest.approx(want[r.sid].b_ge, abs=1e-8) and r.chi2_2df == pytest.approx(want[r.sid].chi2_2df, rel=1e-6)


@pytest.fixture(scope="module")
def binary(spark):
    rng = np.random.default_rng(6)
    n, m = 400, 30
    x = rng.binomial(2, 0.05 + 0.4 * rng.random((m, 1)), size=(m, n)).astype(float)
    x[rng.random((m, n)) < 0.03] = np.nan
    y = (rng.random(n) < 1 / (1 + np.exp(1.5 - np.nan_to_num(x[0])))).astype(float)
    g = keep(spark.createDataFrame([(i, s, None if np.isnan(x[s, i]) else int(x[s, i])) for s in range(m) for i in range(n)], "iid long, sid long, gt int"))
    return x, g, association.fit_logistic(spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "iid long, y double"))


def test_gene_of_one_marker_is_the_marker(spark, binary, tmp_path):
    x, g, model = binary
    write_model(spark, str(tmp_path / "m"), ids=model.ids, y=model.y, mu=model.mu, x=model.x, ratio=1.3)
    saved, ratio = association.saved_logistic(read_model(spark, str(tmp_path / "m")))
    assert ratio == 1.3 and np.array_equal(saved.ids, model.ids) and np.array_equal(saved.mu, model.mu)
    members = spark.createDataFrame([(f"g{s}", s) for s in range(30)], "gene string, sid long")
    genes = {r.gene: r for r in association.burden_score_scan(g, members, saved, ratio).collect()}
    alone = {r.sid: r for r in association.score_scan(g, model, ratio=1.3).collect()}
    assert len(genes) == 30 and any(r.p < 0.05 for r in genes.values())
    for s in range(30):
        one, gene = alone[s], genes[f"g{s}"]
        assert gene.n == 1 and gene.p == pytest.approx(one.p, rel=1e-6) and gene.converge == one.converge
        weight = 25 * (1 - min(np.nanmean(x[s]) / 2, 1 - np.nanmean(x[s]) / 2)) ** 24
        assert abs(gene.t) == pytest.approx(abs(one.t) * weight, rel=1e-9)


def test_gene_of_many_markers(spark, binary):
    x, g, model = binary
    members = spark.createDataFrame([("all", s) for s in range(30)] + [("few", s) for s in (0, 1)], "gene string, sid long")
    got = {r.gene: r for r in association.burden_score_scan(g, members, model).collect()}
    af = np.nanmean(x, axis=1) / 2
    full = np.where(np.isnan(x), 2 * af[:, None], x)
    minor = np.where(af[:, None] > 0.5, 2 - full, full)
    weight = 25 * (1 - np.minimum(af, 1 - af)) ** 24
    for gene, some in (("all", slice(None)), ("few", slice(0, 2))):
        score = (weight[some, None] * minor[some]).sum(axis=0)
        c = score - (score * model.mu * (1 - model.mu)).sum() / (model.mu * (1 - model.mu)).sum()
        assert got[gene].t == pytest.approx(c @ (model.y - model.mu)) and got[gene].n == minor[some].shape[0]
