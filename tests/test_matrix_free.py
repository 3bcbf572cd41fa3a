"""Spectra, variance components and scans by passes against dense matrices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lociflow.operators import association, matrix_free, relatedness, variance
from lociflow.plans.fixture import fixture
from lociflow.plans.storage import keep

SF = "/root/testdata/sf0.01"
N, M = 300, 700


def standard(x):
    """Markers by individuals, missing at 0."""
    mu = np.nanmean(x, axis=1, keepdims=True)
    return np.nan_to_num((x - mu) / np.sqrt(mu * (1 - mu / 2)))


@pytest.fixture(scope="module")
def made(spark):
    """Two populations, relatives in fours, a heritable phenotype and a covariate."""
    rng = np.random.default_rng(4)
    f = np.where(np.arange(N) < N // 2, 0.3, 0.5)
    parents = rng.random((M, N // 4)) < 0.5
    x = rng.binomial(1, f, size=(M, N)) + np.where(rng.random((M, N)) < 0.6, np.repeat(parents, 4, axis=1), rng.binomial(1, f, size=(M, N)))
    x = x.astype(float)
    x[rng.random((M, N)) < 0.02] = np.nan
    x[7] = 2  # does not vary
    z = standard(np.delete(x, 7, axis=0))
    e = rng.normal(size=N)
    y = 3 + 0.5 * e + z.T @ rng.normal(size=M - 1) / np.sqrt(M) + rng.normal(size=N) * 0.7
    ids = np.arange(N) * 2 + 5
    rows = pd.DataFrame({"iid": np.tile(ids, M), "sid": np.repeat(np.arange(M), N), "gt": x.ravel()})
    g = keep(spark.createDataFrame(rows, "iid long, sid long, gt double").withColumn("gt", F.nanvl("gt", F.lit(None))))
    return x, z, y, np.column_stack([np.ones(N), e]), ids, matrix_free.Markers.pack(g, keep), g


def same_up_to_sign(a, b, tolerance):
    assert a.shape == b.shape
    for u, v in zip(a.T, b.T):
        assert min(np.abs(u - v).max(), np.abs(u + v).max()) < tolerance


def test_products_of_markers(made):
    _, z, _, _, ids, markers, _ = made
    q = np.random.default_rng(0).normal(size=(N, 3))
    assert markers.m == M - 1 and np.array_equal(markers.ids, ids)
    assert markers.multiply(q) == pytest.approx(z.T @ (z @ q) / (M - 1))
    rows = {r.sid: r for r in markers.by_marker(q).collect()}
    assert sorted(rows) == [s for s in range(M) if s != 7]
    assert rows[9].products == pytest.approx(list(z[8] @ q)) and rows[9].zz == pytest.approx(z[8] @ z[8])


def test_pieces_add_up_over_levels(spark, monkeypatch):
    monkeypatch.setattr(matrix_free, "PIECE", 64)
    monkeypatch.setattr(matrix_free, "FAN_IN", 2)
    monkeypatch.setattr(matrix_free, "GATHERED", 10)
    parts = [(s, p, bytearray(np.full((min(64, N - 64 * p), 3), float(s + p)).tobytes())) for s in range(7) for p in range(-(-N // 64))]
    out = matrix_free.added(spark.createDataFrame(parts, matrix_free.PARTS), 7, N, 3)
    want = np.repeat([21.0 + 7 * p for p in range(-(-N // 64))], 64)[:N]
    assert np.array_equal(out, np.repeat(want[:, None], 3, axis=1))


def test_leading_pairs_of_markers(made):
    _, z, _, _, _, markers, _ = made
    w, u = np.linalg.eigh(z.T @ z / (M - 1))
    found = matrix_free.leading(markers, 6)
    assert found.values == pytest.approx(w[::-1][:6], rel=1e-9) and found.residuals.max() < 1e-8
    same_up_to_sign(found.vectors, u[:, ::-1][:, :6], 1e-6)


def test_leading_pairs_of_the_fixture(spark):
    f = fixture(spark, SF)
    grm = relatedness.grm(f.g)
    ids, a = relatedness.dense(grm)
    tiles = matrix_free.Tiles(grm, keep)
    w, u = variance.pca(ids, a, 5)
    found = matrix_free.leading(tiles, 5)
    assert np.array_equal(tiles.ids, ids) and found.values == pytest.approx(w[:5], abs=1e-8)
    same_up_to_sign(found.vectors, u, 1e-6)
    markers = matrix_free.Markers.pack(f.g, keep, ids)
    got = {(r.sid, r.k): r.loading for r in matrix_free.loadings(markers, found).collect()}
    want = {(r.sid, r.k): r.loading for r in variance.pc_loadings(f.g, ids, found.values, found.vectors).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_tiles_over_several(made):
    _, z, _, _, ids, _, g = made
    a = z.T @ z / (M - 1)
    i, j = np.tril_indices(N)
    wide = pd.concat([pd.DataFrame({"i": ids[i] + k, "j": ids[j] + k, "value": a[i, j]}) for k in (0, 100_000, 200_000)])  # 900 individuals, two tiles
    tiles = matrix_free.Tiles(g.sparkSession.createDataFrame(wide), keep)
    q = np.random.default_rng(1).normal(size=(3 * N, 2))
    assert tiles.multiply(q) == pytest.approx(np.kron(np.eye(3), a) @ q)


def test_reml_within_the_probes_error(made):
    _, z, y, x, _, markers, _ = made
    a = z.T @ z / (M - 1)
    dense = variance.reml(y, x, [a])
    found = matrix_free.fit(markers, y, x, probes=40)
    h2, se = dense.h2()
    assert abs(found.h2[0] - h2[0]) < 4 * found.probe_error + 1e-3 and found.probe_error < 0.25 * se[0]
    assert found.h2[1] == pytest.approx(se[0], rel=0.25)
    assert found.vg + found.ve == pytest.approx(dense.vp, rel=0.05)
    lrt, _ = variance.likelihood_ratio(dense, y, x, [])
    assert found.lrt[0] == pytest.approx(lrt, rel=0.15, abs=0.5)


def test_solutions_are_exact(made):
    _, z, y, x, _, markers, _ = made
    v = 0.8 * z.T @ z / (M - 1) + 0.5 * np.eye(N)
    b = np.column_stack([y, x])
    assert matrix_free.solve(markers, 0.8, 0.5, b) == pytest.approx(np.linalg.solve(v, b), abs=1e-6)
    top = matrix_free.leading(markers, 5, 1e-4)
    assert matrix_free.solve(markers, 0.8, 0.5, b, top) == pytest.approx(np.linalg.solve(v, b), abs=1e-6)


def test_scan_against_the_dense_one(made):
    _, z, y, x, ids, markers, g = made
    a = z.T @ z / (M - 1)
    inverse = np.linalg.inv(0.8 * a + 0.5 * np.eye(N))
    frame = g.sparkSession.createDataFrame([(int(i), float(v)) for i, v in zip(ids, y)], "iid long, y double")
    exact = {r.sid: r for r in association.joint_covariate_scan(g, frame, x, inverse, ids).collect()}
    p = matrix_free.Projected.of(markers, 0.8, 0.5, x, matrix_free.leading(markers, 5, 1e-4))
    got = {r.sid: r for r in matrix_free.scan(markers, p, y, count=60).collect()}
    assert sorted(got) == sorted(s for s in exact if s != 7)
    ratio = np.array([got[s].chi2 / exact[s].chi2 for s in got if exact[s].chi2 > 0.5])
    assert abs(ratio.mean() - 1) < 0.05 and np.quantile(np.abs(ratio - 1), 0.9) < 0.2
    z_got, z_exact = (np.array([d[s].b / d[s].se for s in got]) for d in (got, exact))
    assert np.corrcoef(z_got, z_exact)[0, 1] > 0.995
    assert np.median([got[s].b / exact[s].b for s in got if exact[s].chi2 > 1]) == pytest.approx(1, abs=0.08)


def test_thirty_thousand_individuals(spark):
    """Two populations of 30,000 individuals: the first component tells them apart, and no matrix of pairs is made."""
    n, m, rng = 30_000, 120, np.random.default_rng(2)
    pop = np.arange(n) % 2
    shift = rng.random(m) * 0.3
    x = rng.binomial(2, 0.3 + shift[:, None] * pop, size=(m, n)).astype(float)
    table = keep(spark.createDataFrame([(s, float(r.mean()), float(np.sqrt(r.mean() * (1 - r.mean() / 2))), bytearray(r.astype(np.float32).tobytes())) for s, r in enumerate(x)], "sid long, mu double, sd double, calls binary"))
    markers = matrix_free.Markers(table, np.arange(n))
    found = matrix_free.leading(markers, 2, 1e-7)
    z = standard(x)
    w, u = np.linalg.eigh(z @ z.T / m)  # the small side's spectrum is the same
    assert found.values == pytest.approx(w[::-1][:2], rel=1e-9)
    v = z.T @ u[:, ::-1][:, :2]
    same_up_to_sign(found.vectors, v / np.linalg.norm(v, axis=0), 1e-6)
    assert abs(np.corrcoef(found.vectors[:, 0], pop)[0, 1]) > 0.9
    y = found.vectors[:, 0] * 100 + rng.normal(size=n)
    solved = matrix_free.solve(markers, 0.5, 0.5, y[:, None], found)
    assert 0.5 * markers.multiply(solved) + 0.5 * solved == pytest.approx(y[:, None], abs=1e-5)
