"""Queries over all chromosomes, instruments and markers, against the parts computed alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.operators import association, relatedness, summary, variance
from lociflow.plans import catalog
from lociflow.plans.fixture import fixture

SF = "/root/testdata/sf0.001"


def test_every_chromosome_is_left_out_once(spark):
    f = fixture(spark, SF)
    got = {r.sid: r for r in catalog.QUERIES["g18_leave_one_chromosome_out"](spark, SF).collect()}
    where = {r.sid: r.chr for r in f.snp.collect()}
    assert len(set(where.values())) == 4 and got.keys() == where.keys()
    for c in (1, 4):
        ids, a = relatedness.dense(relatedness.grm(f.g.join(f.snp.where(F.col("chr") != c).select("sid"), "sid")))
        y = f.pheno.toPandas().set_index("iid").reindex(ids)["y"].to_numpy()
        inverse = variance.reml(y, np.ones((len(y), 1)), [a]).inverse
        own = f.g.join(f.snp.where(F.col("chr") == c).select("sid"), "sid")
        for r in association.mixed_scan(own, f.pheno, inverse, ids).collect():
            for k in ("b", "se", "chi2", "p"):
                assert got[r.sid][k] == pytest.approx(r[k], abs=2e-6, nan_ok=True)


def test_lots_of_chromosomes_give_the_same(spark):
    from lociflow.plans.storage import keep

    f = fixture(spark, SF)
    one = {r.sid: r.b for r in association.leave_one_chromosome_out(f.g, f.snp, f.pheno, keep).collect()}
    lots = {r.sid: r.b for r in association.leave_one_chromosome_out(f.g, f.snp, f.pheno, keep, most_bytes=1).collect()}
    assert lots == pytest.approx(one, nan_ok=True)


def test_instrument_ld():
    import pandas as pd

    pairs = pd.DataFrame([(1, 2, 0.5), (1, 3, 0.1), (1, 4, 0.0), (2, 3, 0.3), (2, 4, -0.1), (3, 4, 0.2)], columns=["sid1", "sid2", "r"])
    kept, r = summary.instrument_ld([1, 2, 3, 4], pairs, 1000)  # 2 is over 0.05 with 1 and 3
    assert list(kept) == [0, 2, 3]
    assert np.array_equal(r, [[1, 0.1, 0], [0.1, 1, 0.2], [0, 0.2, 1]])
    kept, r = summary.instrument_ld([1, 2, 3, 4], pairs, 100)  # p of 0.1 is 0.32, its rate 0.48; p of 0.2 0.046, its rate 0.14
    assert list(kept) == [0, 2, 3] and np.array_equal(r, np.eye(3))


def test_gsmr_takes_ld(spark, monkeypatch):
    seen, plain = [], summary.gsmr
    monkeypatch.setattr(summary, "gsmr", lambda *a, **k: seen.append(a) or plain(*a, **k))
    f = fixture(spark, "/root/testdata/sf0.01")
    got = catalog.QUERIES["m11_m13_gsmr"](spark, "/root/testdata/sf0.01").first()
    bzx, sx, bzy, sy, r = seen[0]
    assert r.shape == (len(bzx), len(bzx)) and np.array_equal(r, r.T) and (np.diag(r) == 1).all()
    assert got.bxy == pytest.approx(plain(bzx, sx, bzy, sy, r)["bxy"], abs=1e-6)
    assert f.g.select("iid").distinct().count() == 100 and (r[~np.eye(len(r), dtype=bool)] ** 2 <= 0.05).all()


def test_ld_search_takes_every_marker(spark):
    from lociflow.operators import linkage

    f = fixture(spark, SF)
    pairs = linkage.window_pairs(f.g, f.snp, 200_000).where(F.col("r") * F.col("r") > linkage._critical_r2(f.ind.count(), 0.05))
    want = pairs.select(F.explode(F.array("sid1", "sid2")).alias("sid")).groupBy("sid").count().collect()
    got = catalog.QUERIES["w8_ld_search"](spark, SF).collect()
    assert len(got) == len({r.sid for r in got}) and {r.sid: r.n_snps for r in got} == {r.sid: r["count"] for r in want}
    assert any(r.sid % 25 for r in got)
