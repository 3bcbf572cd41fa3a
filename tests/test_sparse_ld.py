"""Selection and shrunken effects over sparse LD against dense arrays of a chromosome."""

import numpy as np
import pytest

from lociflow.operators import sparse_ld, summary


def cohort(seed=3, n=600, sizes=((1, 60), (1, 1), (1, 35), (2, 40))):
    """Stretches of correlated markers on chromosomes, far from each other, with effects of some; the dense arrays too."""
    rng = np.random.default_rng(seed)
    parts, chrom, bp, start = [], [], [], 0
    for c, m in sizes:
        base = rng.normal(size=(n, m // 5 + 1))
        parts.append(np.stack([base[:, k // 5] * 0.7 + rng.normal(size=n) * 0.7 for k in range(m)]).T)
        chrom += [c] * m
        bp += [start + 1000 * k for k in range(m)]
        start += 50_000_000
    x = np.concatenate(parts, axis=1)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    m = x.shape[1]
    effects = np.zeros(m)
    effects[[3, 7, 30, 60, 70, 100, 120]] = [0.5, -0.4, 0.3, 0.25, 0.35, 0.6, -0.3]
    y = x @ effects + rng.normal(size=n)
    y -= y.mean()
    freq = rng.uniform(0.1, 0.9, m)
    h = 2 * freq * (1 - freq)
    z = x * np.sqrt(h)
    b = (z * y[:, None]).sum(axis=0) / (n * h)
    se = np.sqrt((y.var() - h * b * b) / (n * h))
    chrom, bp = np.array(chrom), np.array(bp)
    r = x.T @ x / n
    near = (chrom[:, None] == chrom) & (np.abs(bp[:, None] - bp) <= 1_000_000)
    n_eff = rng.uniform(0.8, 1, m) * n
    return chrom, bp, b, se, freq, h, n_eff, np.where(near, r, 0.0), float(y.var())


def tables(spark, c):
    chrom, bp, b, se, freq, h, n_eff, r, vp = c
    m = len(b)
    sid = (np.arange(m) * 7919 % 1009).tolist()  # places differ from ids
    s = spark.createDataFrame([(sid[k], float(b[k]), float(se[k]), float(freq[k]), float(n_eff[k]), float(h[k])) for k in range(m)], "sid long, b double, se double, freq double, n_eff double, v double")
    snp = spark.createDataFrame([(sid[k], int(chrom[k]), int(bp[k])) for k in range(m)] + [(5000, 1, 7)], "sid long, chr int, bp int")
    i, j = np.nonzero(np.triu(r, 1))
    pairs = [(sid[a], sid[e], float(r[a, e])) for a, e in zip(i, j)]
    pairs = [(q, p, v) if k % 3 == 0 else (p, q, v) for k, (p, q, v) in enumerate(pairs)] + [(sid[0], sid[60], float("nan")), (sid[0], 5000, 0.5)]
    return sid, s, spark.createDataFrame(pairs, "sid1 long, sid2 long, r double"), snp


def dense(c, at):
    chrom, bp, b, se, freq, h, n_eff, r, vp = c
    return summary.Region(at, b[at], se[at], n_eff[at], h[at], h[at], r[np.ix_(at, at)], vp)


@pytest.fixture(scope="module")
def data(spark):
    c = cohort()
    return c, *(d if isinstance(d, list) else d.cache() for d in tables(spark, c))


def by_sid(df):
    return {r.sid: r for r in df.collect()}


def test_regions_end_at_gaps(data):
    c, sid, s, pairs, snp = data
    markers, _ = sparse_ld.placed(s, pairs, snp)
    rows = sorted(markers.collect(), key=lambda r: r.place)
    assert [r.sid for r in rows] == sid and [r.place for r in rows] == list(range(len(sid)))
    assert sorted({(r.region, r.chr) for r in rows}) == [(0, 1), (60, 1), (61, 1), (96, 2)]


@pytest.mark.parametrize("places", [4096, 8])
def test_stepwise_is_that_of_dense_arrays(data, monkeypatch, places):
    monkeypatch.setattr(sparse_ld, "PLACES", places)
    c, sid, s, pairs, snp = data
    got = by_sid(sparse_ld.cojo(s, pairs, snp, c[-1], 1e-3))
    want = {}
    for a, e in ((0, 60), (60, 61), (61, 96), (96, 136)):
        g = dense(c, np.arange(a, e))
        chosen = g.stepwise(1e-3)
        if chosen:
            want |= {sid[a + k]: v for k, *v in zip(chosen, *g.joint(chosen))}
    assert len(want) >= 6 and got.keys() == want.keys()
    for k, (b, se) in want.items():
        assert (got[k].bj, got[k].bj_se) == pytest.approx((b, se), rel=1e-9)


def test_top_over_all_regions(data):
    c, sid, s, pairs, snp = data
    g = dense(c, np.arange(len(sid)))
    for top in (1, 4, 9, 1000):
        chosen = g.stepwise(0.05, top=top)
        assert set(by_sid(sparse_ld.cojo(s, pairs, snp, c[-1], 0.05, top=top))) == {sid[k] for k in chosen}


def test_forward_and_backward(data):
    c, sid, s, pairs, snp = data
    forward = by_sid(sparse_ld.cojo(s, pairs, snp, c[-1], 1e-3, way="forward"))
    assert forward.keys() >= by_sid(sparse_ld.cojo(s, pairs, snp, c[-1], 1e-3)).keys()
    few = s.where(s.sid.isin([sid[k] for k in (3, 7, 12, 30, 60, 70, 75, 100, 101, 120)]))
    chosen, g = [0, 1, 2, 3], dense(c, np.array([3, 7, 12, 30]))
    while True:
        b, se = g.joint(chosen)
        chi = (b / se) ** 2
        if sparse_ld.chi2_tail(float(chi.min())) <= 1e-3:
            break
        chosen.pop(int(chi.argmin()))
    backward = by_sid(sparse_ld.cojo(few, pairs, snp, c[-1], 1e-3, way="backward"))
    assert {sid[(3, 7, 12, 30)[k]] for k in chosen} == backward.keys() & {sid[k] for k in (3, 7, 12, 30)}
    with pytest.raises(ValueError):
        sparse_ld.cojo(s, pairs, snp, 1.0, way="sideways")


def test_joint_and_conditional(spark, data):
    c, sid, s, pairs, snp = data
    at = [2, 7, 30, 58, 70]
    given = [sid[k] for k in at]
    g = dense(c, np.arange(96))  # the first chromosome
    b, se = g.joint(at)
    got = by_sid(sparse_ld.cojo_joint(s, pairs, snp, c[-1], spark.createDataFrame([(k,) for k in given + given[:1]], "sid long")))
    assert [got[k].bj for k in given] == pytest.approx(b.tolist(), rel=1e-9) and [got[k].bj_se for k in given] == pytest.approx(se.tolist(), rel=1e-9)
    b, se = g.conditional(at)
    got = by_sid(sparse_ld.cojo_conditional(s, pairs, snp, c[-1], given))
    assert {sid[k] for k in range(96) if b[k] == b[k]} == {k for k, r in got.items() if r.chr == 1}
    for k in range(96):
        if b[k] == b[k]:
            assert (got[sid[k]].bc, got[sid[k]].bc_se) == pytest.approx((b[k], se[k]), rel=1e-8, abs=1e-12)
    assert (got[sid[100]].bc, got[sid[100]].bc_se) == (c[2][100], c[3][100])


@pytest.mark.parametrize("shrink", [1000.0, 0.5])
def test_sblup_is_the_dense_solution(data, shrink):
    c, sid, s, pairs, snp = data
    chrom, bp, b, se, freq, h, n_eff, r, vp = c
    a = r * np.minimum.outer(n_eff, n_eff)
    np.fill_diagonal(a, n_eff + shrink)
    want = np.linalg.solve(a, np.sqrt(h) * n_eff * b)
    got = by_sid(sparse_ld.sblup(s, pairs, snp, shrink))
    assert [got[k].u for k in sid] == pytest.approx(want.tolist(), rel=1e-7, abs=1e-9)


def test_products_that_are_not_positive():
    a = np.array([[1.0, 0.9, 0.0], [0.9, 1.0, 0.9], [0.0, 0.9, 1.0]])  # LD cut by a window
    rhs = np.array([1.0, 2.0, -1.0])
    assert sparse_ld.conjugate_gradients(lambda x: a @ x, rhs, np.ones(3), 100) is None
    x = sparse_ld.conjugate_gradients(lambda x: a @ (a @ x), a @ rhs, np.ones(3), 100)
    assert x == pytest.approx(np.linalg.solve(a, rhs))


def test_empty_tables(data):
    c, sid, s, pairs, snp = data
    assert sparse_ld.cojo(s.limit(0), pairs, snp, 1.0).count() == 0
    assert sparse_ld.cojo(s.limit(0), pairs, snp, 1.0, top=3).count() == 0
    assert sparse_ld.sblup(s, pairs.limit(0), snp, 10.0).count() == len(sid)
