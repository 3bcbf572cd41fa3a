"""The whole conditioning of an outcome on two exposures, from summary rows to corrected effects."""

import numpy as np
import pandas as pd
import pytest

from lociflow.operators import summary
from lociflow.plans.storage import keep


def traits(m=2000, n=50_000.0, seed=4):
    """Two correlated exposures over the first half of the markers, an outcome of both and of the other half."""
    rng = np.random.default_rng(seed)
    ld = rng.uniform(1, 60, m)
    size = np.sqrt(ld / ld.sum())
    half = np.arange(m) < m // 2
    one = rng.normal(size=m)
    x1 = one * size * np.sqrt(0.4) * np.where(half, np.sqrt(2), 0)
    x2 = (0.3 * one + np.sqrt(1 - 0.09) * rng.normal(size=m)) * size * np.sqrt(0.3) * np.where(half, np.sqrt(2), 0)
    y = 0.4 * x1 + 0.2 * x2 + rng.normal(size=m) * size * np.sqrt(0.1) * np.where(half, 0, np.sqrt(2))
    se = 1 / np.sqrt(n)
    rows = [pd.DataFrame({"sid": np.arange(m), "snp": [f"rs{k}" for k in range(m)], "trait": t, "b": v + rng.normal(size=m) * se, "se": se, "n": n}) for t, v in (("y", y), ("x1", x1), ("x2", x2))]
    s = pd.concat(rows, ignore_index=True)
    s["chi2"] = (s.b / s.se) ** 2
    return s, ld, x1, x2


def test_two_exposures(spark):
    s, ld, x1, x2 = traits()
    m = len(ld)
    frame = spark.createDataFrame(s)
    scores = spark.createDataFrame(pd.DataFrame({"sid": np.arange(m), "ld": ld, "w_ld": ld}))
    snp = spark.createDataFrame(pd.DataFrame({"sid": np.arange(m), "chr": (np.arange(m) % 22 + 1).astype("int32"), "bp": (np.arange(m) // 22 * 20_000_000).astype("int64")}))
    rng = np.random.default_rng(1)
    g = spark.createDataFrame(pd.DataFrame([(i, k, int(rng.binomial(2, 0.4))) for k in range(40) for i in range(60)], columns=["iid", "sid", "gt"]))
    rows, found = summary.mtcojo(frame, g, snp, scores, "y", ["x1", "x2"], keep, m, heidi_p=0.0)
    assert found.rg[0, 1] == pytest.approx(0.3, abs=0.12) and found.h2 * ld.mean() == pytest.approx([0.4, 0.3], abs=0.12)  # a marker's score tells of its own variance
    assert found.joint == pytest.approx([0.4, 0.2], abs=0.06) and found.bxy[0] > found.joint[0]
    assert np.diag(found.intercepts) == pytest.approx(np.ones(3), abs=1.5)  # chi-squares average eleven, so errors are about a half
    got = rows.toPandas().set_index("snp").loc[[f"rs{k}" for k in range(m)]]
    assert len(got) == m
    for x in (x1, x2):
        assert abs(np.corrcoef(got.bc[: m // 2], x[: m // 2])[0, 1]) < 0.35  # before: 0.9 and 0.5
    marginal = s[s.trait == "y"].b.to_numpy()[: m // 2]
    assert np.var(got.bc[: m // 2]) < 0.5 * np.var(marginal)
    with pytest.raises(ValueError, match="instruments"):
        summary.mtcojo(frame, g, snp, scores, "y", ["x1", "x2"], keep, m, least_chi2=1e6)
