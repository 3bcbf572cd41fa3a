"""Distribution functions, variance components and summary analyses against closed forms and plain computations."""

import math

import numpy as np
import pytest

from lociflow.functions import stats
from lociflow.operators import association, relatedness, summary, variance


def test_tails():
    assert stats.chi2_tail(3.841458820694124) == pytest.approx(0.05, rel=1e-9)
    assert stats.chi2_tail(1000.0) == pytest.approx(math.erfc(math.sqrt(500)), rel=1e-12)
    assert stats.chi2_tail(7.814727903251178, 3) == pytest.approx(0.05, rel=1e-9)
    assert stats.gamma_upper(1.0, 5.0) == pytest.approx(math.exp(-5), rel=1e-12)
    assert stats.t_tail(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-8)
    assert stats.f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05, rel=1e-8)
    assert stats.normal_quantile(0.975) == pytest.approx(1.959963984540054, rel=1e-9)
    assert stats.chi2_quantile(0.05) == pytest.approx(3.841458820694124, rel=1e-8)
    assert stats.chi2_quantile(0.05, 4) == pytest.approx(9.487729036781154, rel=1e-8)


def test_mixture_tail():
    assert stats.chi2_mixture_tail(9.0, np.array([2.0])) == pytest.approx(stats.chi2_tail(4.5))
    assert stats.chi2_mixture_tail(9.0, np.ones(3)) == pytest.approx(stats.chi2_tail(9.0, 3))
    rng = np.random.default_rng(1)
    w = np.array([3.0, 1.0, 0.5, 0.2])
    draws = (rng.normal(size=(400_000, 4)) ** 2) @ w
    for x in (5.0, 12.0, 20.0):
        assert stats.chi2_mixture_tail(x, w) == pytest.approx((draws > x).mean(), rel=0.05)


def test_spline_and_pi0():
    x = np.linspace(0, 3, 20)
    assert stats.cubic_spline(x, np.sin(x), np.array([0.77, 2.1])) == pytest.approx(np.sin([0.77, 2.1]), abs=1e-3)
    assert 0.8 < stats.pi0(np.random.default_rng(2).random(20_000)) <= 1
    q = stats.storey(np.array([1e-6, 0.5, 0.9, 0.2]))
    assert q[0] < 1e-5 and (q <= 1).all()


@pytest.fixture(scope="module")
def simulated():
    rng = np.random.default_rng(3)
    z = rng.normal(size=(300, 1500))
    a = z @ z.T / 1500
    y = np.linalg.cholesky(a + 1e-8 * np.eye(300)) @ rng.normal(size=300) * math.sqrt(0.6) + rng.normal(size=300) * math.sqrt(0.4)
    return a, y


def test_reml_is_a_maximum(simulated):
    a, y = simulated
    x = np.ones((300, 1))
    m = variance.reml(y, x, [a])
    assert m.converged
    for k in range(2):
        for f in (0.9, 1.1):
            t = m.theta.copy()
            t[k] *= f
            assert variance.reml(y, x, [a], start=t, fixed=True).logl <= m.logl + 1e-6
    fisher = variance.reml(y, x, [a], algorithm="fisher")
    assert fisher.theta == pytest.approx(m.theta, rel=1e-3)
    g, e = variance.blup(m, [a], y, x)
    assert g + e == pytest.approx(y - (x @ m.beta).ravel(), abs=1e-6)
    vg, ve, _ = variance.sparse_reml(y, a)
    assert vg + ve == pytest.approx(np.var(y, ddof=1))


def test_pca_and_families(simulated):
    a, _ = simulated
    w, u = variance.pca(np.arange(300), a, 3)
    assert w.sum() == pytest.approx(np.trace(a)) and a @ u[:, 0] == pytest.approx(w[0] * u[:, 0], abs=1e-8)
    m = np.eye(6)
    m[0, 3] = m[3, 0] = m[3, 5] = m[5, 3] = 0.5
    assert [list(f) for f in variance.detect_families(m)] == [[0, 3, 5], [1], [2], [4]]


def test_bivariate(simulated):
    a, y = simulated
    theta, rg, se = variance.bivariate_reml(y, y + np.random.default_rng(5).normal(size=300) * 0.3, a)
    assert rg > 0.7 and se > 0


def test_spa_near_normal():
    rng = np.random.default_rng(4)
    mu, g = np.full(4000, 0.4), rng.binomial(2, 0.3, 4000) - 0.6
    sd = math.sqrt((g * g * mu * (1 - mu)).sum())
    for z in (2.0, 3.0):
        p, ok = association.spa_p(z * sd, g, mu)
        assert ok and p == pytest.approx(stats.chi2_tail(z * z), rel=0.1)


def region():
    rng = np.random.default_rng(6)
    n, m = 2000, 12
    x = rng.normal(size=(n, m))
    x[:, 1] = 0.8 * x[:, 0] + 0.6 * x[:, 1]
    y = 0.3 * x[:, 0] + 0.25 * x[:, 7] + rng.normal(size=n)
    x = (x - x.mean(0)) / x.std(0)
    y = y - y.mean()
    b = x.T @ y / n
    se = np.sqrt((y.var() - b * b) / n)
    r = x.T @ x / n
    return summary.Region(np.arange(m), b, se, np.full(m, float(n)), np.ones(m), np.ones(m), r, float(y.var())), x, y


def test_cojo():
    g, x, y = region()
    chosen = g.stepwise(1e-6)
    assert chosen == [0, 7]
    joint, _ = g.joint(chosen)
    assert joint == pytest.approx(np.linalg.lstsq(x[:, chosen], y, rcond=None)[0], abs=1e-6)
    b, _ = g.conditional([0])
    assert math.isnan(b[0]) and b[7] == pytest.approx(np.linalg.lstsq(x[:, [0, 7]], y, rcond=None)[0][1], abs=0.01)
    assert g.joint([3])[0][0] == pytest.approx(g.b[3])


def test_gsmr():
    bzx = np.array([0.1, 0.2, 0.15, -0.12, 0.3])
    out = summary.gsmr(bzx, np.full(5, 0.01), 0.4 * bzx, np.full(5, 0.01))
    assert out["bxy"] == pytest.approx(0.4) and out["n"] == 5
    bad = 0.4 * bzx
    bad[4] += 0.5
    out = summary.gsmr(bzx, np.full(5, 0.01), bad, np.full(5, 0.01))
    assert 4 not in out["kept"] and out["bxy"] == pytest.approx(0.4)


def test_ldsc(spark):
    rng = np.random.default_rng(7)
    m, n = 4000, 50_000.0
    ld = rng.uniform(1, 60, m)
    chi = 1.05 + n * 0.3 / m * ld
    df = spark.createDataFrame([(float(c), n, float(v), float(v)) for c, v in zip(chi, ld)], "chi2 double, n double, ld double, w_ld double")
    fit = summary.ldsc_h2(df, m, two_steps=False)
    assert fit.value == pytest.approx(0.3, rel=1e-6) and fit.intercept == pytest.approx(1.05, rel=1e-6)


def test_grm_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(7, 30))
    cells = [(i + 510, j + 1010, float(x[i, j]) if (i + j) % 5 else None) for i in range(7) for j in range(30)]
    got = {(r.i, r.j): (r.n, r.s) for r in relatedness.pair_products(spark.createDataFrame(cells, "iid long, sid long, x double")).collect()}
    have = np.array([[(i + j) % 5 != 0 for j in range(30)] for i in range(7)])
    z = np.where(have, x, 0)
    for i in range(7):
        for j in range(i + 1):
            n, s = got[i + 510, j + 510]
            assert n == (have[i] & have[j]).sum() and s == pytest.approx(z[i] @ z[j])


def test_rank_contrasts():
    from lociflow.operators.markers import rank_contrasts

    q = rank_contrasts(5)
    assert q.T @ q == pytest.approx(np.eye(4), abs=1e-12) and q.sum(axis=0) == pytest.approx(np.zeros(4), abs=1e-12)


def test_weighted_residuals_are_a_rescaled_model():
    rng = np.random.default_rng(8)
    z = rng.normal(size=(150, 60))
    a, w = z @ z.T / 60, rng.uniform(0.5, 3, 150)
    y, x = z @ rng.normal(size=60) / 4 + np.sqrt(w) * rng.normal(size=150), np.ones((150, 1))
    s = 1 / np.sqrt(w)
    one, two = variance.reml(y, x, [a], weights=w), variance.reml(s * y, s[:, None] * x, [a * np.outer(s, s)])
    assert one.theta.min() > 0.1 and np.allclose(one.theta, two.theta, rtol=1e-3)


def test_models_are_kept(spark, tmp_path):
    from lociflow.sources import text

    parts = {"theta": np.array([0.5, 1.5]), "inverse": np.arange(6.0).reshape(2, 3), "logl": -3.25}
    text.write_model(spark, str(tmp_path / "m"), **parts)
    back = text.read_model(spark, str(tmp_path / "m"))
    assert back.keys() == parts.keys() and all(np.array_equal(back[k], parts[k]) for k in parts)


def test_packed_markers(spark):
    from lociflow.operators.linkage import packed

    rows = [(9, 1, 2), (3, 1, 0), (5, 1, None), (9, 2, 1), (3, 2, 1), (5, 7, 2)]  # marker 2 lacks 5, marker 7 has only 5
    g = spark.createDataFrame(rows, "iid long, sid long, gt int").repartition(5)
    want = {1: [0, math.nan, 2], 2: [1, math.nan, 1], 7: [math.nan, 2, math.nan]}
    for d in (packed(g), packed(g, ids=np.array([3, 5, 9]))):
        got = {r.sid: r.x for r in d.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], nan_ok=True) for k in want)
    assert [(r.sid, r.chr, r.bp) for r in packed(g, spark.createDataFrame([(7, 2, 50)], "sid long, chr int, bp int")).collect()] == [(7, 2, 50)]
    assert packed(g.limit(0)).count() == 0


def test_quantiles_and_deviates(spark):
    from pyspark.sql import functions as F

    assert stats.t_quantile(0.05, 10) == pytest.approx(2.2281388519649385, rel=1e-8)
    assert stats.f_quantile(0.05, 1, 10) == pytest.approx(4.964602743730711, rel=1e-8)
    d = spark.range(20_000).select("id", stats.uniform_deviate(3, "id").alias("u"), stats.normal_deviate(3, "id").alias("z"), stats.gamma_deviate(2.5, 3, "id").alias("g"), stats.chi2_deviate(4, 3, "id").alias("c"))
    r = d.agg(*[f(k).alias(f"{n}_{k}") for k in "uzgc" for n, f in (("m", F.avg), ("v", F.var_samp))], F.min("u").alias("lo"), F.max("u").alias("hi")).first()
    assert 0 < r.lo < 0.001 and 0.999 < r.hi < 1
    for k, mean, var in (("u", 0.5, 1 / 12), ("z", 0.0, 1.0), ("g", 2.5, 2.5), ("c", 4.0, 8.0)):
        assert r[f"m_{k}"] == pytest.approx(mean, abs=5 * math.sqrt(var / 20_000)) and r[f"v_{k}"] == pytest.approx(var, rel=0.1)
    assert d.where("id = 7").first() == d.repartition(3).where("id = 7").first()
