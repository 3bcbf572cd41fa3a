"""Inverses and bending, GSMR over several traits, LD files, reasons of rejected rows, run logs."""

import logging

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lociflow.log import LOG, run_log
from lociflow.operators import linkage, markers, summary, variance
from lociflow.plans.storage import keep
from lociflow.sources import binary


@pytest.mark.parametrize("seed", range(20))
def test_inverses(seed):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(200, 200)))
    for w, way in ((np.linspace(0.5, 2, 200), "cholesky"), (np.r_[-0.5, np.linspace(1, 2, 199)], "lu"), (np.r_[-0.1, np.full(11, 0.1), np.ones(188)], "qr"), (np.r_[0.0, np.ones(199)], "rank")):
        m = (q * w) @ q.T
        inverse, logdet, by = variance.inverted((m + m.T) / 2)
        assert by == way and logdet == pytest.approx(np.log(np.abs(w[w != 0])).sum(), rel=1e-4)
        assert np.allclose(m @ inverse @ m, m, atol=1e-5)
    with pytest.raises(np.linalg.LinAlgError):
        variance.inverted((q * np.r_[np.zeros(100), np.ones(100)]) @ q.T)


def test_bending():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(50, 50)))
    m = (q * np.r_[-0.3, -0.1, -0.02, np.linspace(0.1, 3, 47)]) @ q.T
    bent = variance.bend(m)
    w = np.linalg.eigvalsh(bent)
    assert (w > 0).all() and w[:3].max() < 0.05 and np.trace(bent) == pytest.approx(np.trace(m))
    assert variance.bend(bent) is bent  # nothing is left to bend


def test_gsmr_of_several_traits(spark):
    rng = np.random.default_rng(3)
    n, m = 120, 60
    x = rng.binomial(2, 0.4, size=(m, n))
    s, i = np.indices((m, n))
    g = spark.createDataFrame(pd.DataFrame({"iid": i.ravel(), "sid": s.ravel(), "gt": x.ravel()}))
    snp = spark.createDataFrame([(k, 1, 20_000_000 * k) for k in range(m)], "sid long, chr int, bp long")
    b = rng.normal(size=m)
    rows = []
    for k in range(m):
        strong = k < 30
        bx = b[k] + np.sign(b[k])
        by = 0.4 * bx + (1.0 if k == 7 else 0.0)  # 7 acts on y beside x
        rows += [(k, "x", bx, 0.01, 99.0 if strong else 1.0), (k, "y", by, 0.01, 99.0 if 30 <= k < 34 else 1.0), (k, "z", 0.1 * bx if k != 2 else None, 0.01, 1.0)]
    t = spark.createDataFrame([(k, t, None if v is None else float(v), e, c) for k, t, v, e, c in rows], "sid long, trait string, b double, se double, chi2 double")
    results, used = summary.gsmr_traits(t, g, snp, ["x"], ["y", "z"], keep, "both")
    got = {(r.exposure, r.outcome): r for r in results.collect()}
    assert set(got) == {("x", "y"), ("x", "z"), ("y", "x"), ("z", "x")}
    assert got["x", "y"].bxy == pytest.approx(0.4, abs=1e-3) and got["x", "z"].bxy == pytest.approx(0.1, abs=1e-3)
    assert got["y", "x"].bxy is None and got["z", "x"].n == 0  # four instruments, and none
    by_pair = {p: {r.sid: r.outlier for r in used.where((F.col("exposure") == p[0]) & (F.col("outcome") == p[1])).collect()} for p in got}
    kept, _ = summary.instrument_ld(list(range(30)), summary.selected_ld(g, spark.range(30).withColumnRenamed("id", "sid")).toPandas(), n)
    assert set(by_pair["x", "y"]) == set(kept) and [k for k, o in by_pair["x", "y"].items() if o] == ([7] if 7 in kept else [])
    assert 2 not in by_pair["x", "z"] and not by_pair["y", "x"]
    assert got["x", "y"].n == len(kept) - (7 in kept)
    with pytest.raises(ValueError):
        summary.gsmr_traits(t, g, snp, ["x"], ["y"], keep, "sideways")


def test_ld_file(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.binomial(2, 0.4, size=(12, 40))
    s, i = np.indices(x.shape)
    g = spark.createDataFrame(pd.DataFrame({"iid": i.ravel(), "sid": s.ravel(), "gt": x.ravel()}))
    # sids don't stand in order of place, and the last marker has no neighbour
    snp = spark.createDataFrame([(k, 1 + k % 2, 1000 * (12 - k) if k else 900_000) for k in range(12)], "sid long, chr int, bp long")
    pairs = keep(linkage.window_pairs(g, snp, 4000))
    path = str(tmp_path / "w.zld")
    binary.write_ld(pairs, snp, path)
    want = {(r.sid1, r.sid2): float(np.float32(r.r)) for r in pairs.collect()}
    back = [(r.sid1, r.sid2, r.r) for r in binary.read_ld(spark, path).collect()]
    assert len(back) == len(want) > 0 and {(a, b): r for a, b, r in back} == want
    raw = open(path, "rb").read()
    assert len(raw) == 12 * 8 + 4 * len(want)


def test_rejected_rows(spark):
    snp = spark.createDataFrame([("a", "A", "G"), ("b", "A", "G"), ("c", "A", "G"), ("d", "A", "G")], "name string, a1 string, a2 string")
    freq = spark.createDataFrame([("a", 0.3), ("b", 0.3), ("c", 1.0)], "snp string, freq double")
    s = spark.createDataFrame([("a", "G", "A", 0.7), ("b", "A", "G", 0.7), ("c", "A", "C", 0.1), ("d", "A", "G", None), ("e", "A", "G", 0.5), ("b", "A", None, 0.3)], "snp string, a1 string, a2 string, freq double")
    got = sorted((r.snp, r.reason) for r in markers.rejected(s, snp, freq).collect())
    assert got == [("b", "alleles"), ("b", "frequency"), ("c", "alleles"), ("c", "monomorphic"), ("e", "absent")]


def test_too_many_frequencies_differ(spark):
    s = spark.createDataFrame([(f"s{k}", 0.5) for k in range(40)], "snp string, freq double")
    ref = spark.createDataFrame([("s0", 0.1), ("s1", 0.9), ("other", 0.2)], "snp string, freq double")
    left = markers.without_frequency_outliers(s, ref)
    assert left.count() == 38 and not left.where("snp in ('s0', 's1')").count()
    with pytest.raises(ValueError):
        markers.without_frequency_outliers(s.where("snp <> 's9'"), ref)


def test_run_log(tmp_path):
    with pytest.raises(ValueError), run_log(str(tmp_path / "r")) as log:
        log.info("markers: %d", 5)
        raise ValueError("no markers")
    lines = (tmp_path / "r.log").read_text().splitlines()
    assert lines[0].startswith("Started") and lines[1:3] == ["markers: 5", "Error: no markers"] and lines[3].startswith("Seconds")
    assert not LOG.handlers and logging.getLogger("lociflow") is LOG
