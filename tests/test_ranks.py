"""Ranks and running values over partitions against plain code."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lociflow.functions import ranks, stats


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(40) / 8 if rng.random() < 0.9 else None, rng.random() ** 3) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id long, s string, x double, p double").repartition(9)


def test_numbered(made):
    rows, d = made
    got = {r.id: r.place for r in ranks.numbered(d, "s", "id").collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    assert got == {r[0]: k for k, r in enumerate(order)}
    assert ranks.numbered(d.where("false"), "id").count() == 0


def test_first_ranks(made):
    rows, d = made
    known = sorted(r[2] for r in rows if r[2] is not None)
    got = ranks.first_ranks(d, "x").collect()
    assert len(got) == len(rows)
    assert all(r["rank"] is None if r.x is None else r["rank"] == 1 + np.searchsorted(known, r.x) for r in got)


def test_numbered_lines(spark, tmp_path):
    """Over many splits of one file, after a filter."""
    (tmp_path / "t").write_text("".join(f"line {i}\n" + "\n" * (i % 3 == 0) for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = spark.read.text(str(tmp_path / "t"))
        assert lines.rdd.getNumPartitions() > 5
        got = ranks.numbered_lines(lines.where("value <> ''"), "k").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.k for r in got) == list(range(20_000)) and all(r.value == f"line {r.k}" for r in got)


def test_false_discovery_rates(made):
    rows, d = made
    p = np.array([r[3] for r in rows])
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    want = np.empty(len(p))
    want[order] = np.minimum(q, 1)
    got = {r.id: r.fdr for r in stats.benjamini_hochberg(d.withColumn("p", F.when(F.col("id") < 3000, F.col("p"))), "p", "id").collect()}
    assert got == pytest.approx({r[0]: want[k] for k, r in enumerate(rows)})
    with_null = {r.id: r.fdr for r in stats.benjamini_hochberg(d.withColumn("p", F.when(F.col("id") != 5, F.col("p"))), "p", "id").collect()}
    assert with_null[5] is None and sum(v is None for v in with_null.values()) == 1
    assert stats.null_share(d, "p") == pytest.approx(stats.pi0(p))
    assert stats.null_share(d, "p", 0.5) == pytest.approx((p >= 0.5).mean() / 0.5)
    share = stats.null_share(d, "p")
    q_got = {r.id: r.q for r in stats.q_values(d, "p", "id", share).collect()}
    assert q_got == pytest.approx({r[0]: min(1, want[k] * share) for k, r in enumerate(rows)})
    assert stats.null_share(d.where("false"), "p") == 1.0


def test_inverse_normal(made):
    from statistics import NormalDist

    rows, d = made
    known = pd.Series([r[2] for r in rows]).dropna()
    got = stats.inverse_normal(d, "x").collect()
    for r in got:
        if r.x is None:
            assert r.z is None
        else:
            p = ((known < r.x).sum() + 0.5) / len(known)
            assert math.isclose(r.z, NormalDist().inv_cdf(p), abs_tol=1e-9)
