"""Packed calls stand on disk once, whatever the pairs of tiles, and matrices don't have the genotypes written first."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.operators import relatedness
from lociflow.plans import catalog, fixture


def cells_of(spark, code):
    return spark.createDataFrame([(i, m, int(c) if c >= 0 else None) for (i, m), c in np.ndenumerate(code)], "iid long, sid long, gt int").repartition(3)


def expected(code):
    x = np.where(code < 0, np.nan, code)
    mu = np.nanmean(x, axis=0)
    z = (x - mu) / np.sqrt(mu * (1 - mu / 2))
    n = (~np.isnan(x)).astype(int) @ (~np.isnan(x)).T.astype(int)
    return n, np.nan_to_num(z) @ np.nan_to_num(z).T / n


def patched(monkeypatch, **values):
    for name, v in values.items():
        monkeypatch.setattr(relatedness, name, v)


def physical(d):
    return d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("patch, shuffled", [({"TILE": 8, "LARGE": 16, "SMALL": 16, "MARKERS": 16, "HELD": 2}, False), ({"MARKERS": 16}, True)])
def test_runs_are_not_shuffled_to_pairs(spark, monkeypatch, patch, shuffled):
    """With as many pairs of tiles as cores nothing is shuffled; with one pair only its tasks' sums are."""
    patched(monkeypatch, **patch)
    code = np.random.default_rng(11).integers(-1, 3, (41, 83))
    d = relatedness.grm(cells_of(spark, code))
    assert ("Exchange" in physical(d)) == shuffled and "Generate" not in physical(d)
    n, value = expected(code)
    got = {(r.i, r.j): (r.n, r.value) for r in d.collect()}
    assert set(got) == {(i, j) for i in range(41) for j in range(i + 1)}
    assert all(k == n[p] and v == pytest.approx(value[p], abs=1e-12) for p, (k, v) in got.items())


def test_counts_of_packed_calls(spark, monkeypatch):
    patched(monkeypatch, TILE=8, LARGE=16, SMALL=16, MARKERS=16)
    code = np.random.default_rng(12).integers(-1, 3, (29, 40))
    code[:, 7] = -1
    g = cells_of(spark, code)
    codes = relatedness.Codes(g.select("iid", "sid", F.col("gt").alias("code")), 3)
    got = {r.sid: (r.c0, r.c1, r.c2) for r in codes.counts().collect()}
    assert got == {m: tuple(int((code[:, m] == k).sum()) for k in range(3)) for m in range(40) if m != 7}
    one, two = ({r.sid: (r.mu, r.var) for r in d.collect()} for d in (relatedness.counted(codes), relatedness.variances(g)))
    assert one == two


@pytest.mark.parametrize("name", ["a4_grm", "a5_grm_centred", "a29_he_jackknife"])
def test_genotypes_are_not_written_for_a_matrix(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(fixture, "_made", {})
    d = catalog.QUERIES[name](spark, sf_dir)
    (f,) = fixture._made.values()
    assert "g" not in vars(f) and d.count() > 0
    assert f.g.count() == f.ind.count() * f.snp.count() and f.calls is f.g


def test_a_dense_matrix_is_gathered_as_bytes(spark, monkeypatch):
    from pyspark.sql import DataFrame

    a = spark.createDataFrame([(7, 7, 1.0), (9, 9, 2.0), (9, 7, -0.5), (3, 3, None), (7, 3, 0.25)], "i long, j long, value double").repartition(3)
    ind = spark.createDataFrame([(3,), (7,), (9,), (11,)], "iid long")
    monkeypatch.delattr(type(a), "toPandas", raising=False)
    monkeypatch.delattr(DataFrame, "toPandas", raising=False)
    for individuals in (None, ind):
        ids, m = relatedness.dense(a, individuals=individuals)
        assert ids.tolist() == [3, 7, 9]
        assert np.array_equal(m, [[np.nan, 0.25, 0], [0.25, 1, -0.5], [0, -0.5, 2]], equal_nan=True)
        with pytest.raises(ValueError, match="over 2 individuals"):
            relatedness.dense(a, 2, individuals)


def test_a_binary_model_inverts_no_matrix_for_a_point_of_its_grid(monkeypatch):
    from lociflow.operators import variance

    rng = np.random.default_rng(6)
    z = rng.normal(size=(80, 160))
    k = z @ z.T / 160
    y = (rng.random(80) < 1 / (1 + np.exp(-2 * np.linalg.cholesky(k) @ rng.normal(size=80)))).astype(float)
    x = np.column_stack([np.ones(80), rng.normal(size=80)])
    whole = variance.fit_binary_mixed(y, x, k)
    w = whole.mu * (1 - whole.mu)
    inverse = np.linalg.inv(whole.tau * k + np.diag(1 / w))
    p = inverse - inverse @ x @ np.linalg.solve(x.T @ inverse @ x, x.T @ inverse)
    assert np.allclose(whole.p, p)
    monkeypatch.setattr(np.linalg, "inv", None)
    less = variance.fit_binary_mixed(y, x, k, covariance=False)
    assert less.p is None and less.tau == whole.tau and np.array_equal(less.mu, whole.mu)
