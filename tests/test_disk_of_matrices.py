"""What the matrix queries write between steps, and that their rows stay what they were."""

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.operators import linkage, relatedness
from lociflow.plans import catalog
from lociflow.plans.storage import keep


def rows(d):
    return {tuple(r)[:2]: tuple(r)[2:] for r in d.collect()}


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_a_list_of_individuals_is_compressed_over_markers(spark):
    """20 markers of 20,000 individuals: the list is 37 KB, and was in the file once for each marker."""
    d = keep(spark.range(400_000, numPartitions=1).select((F.col("id") % 20_000).alias("iid"), F.floor(F.col("id") / 20_000).alias("sid")))
    files = [Path(p.removeprefix("file:").replace("///", "/")) for p in d.inputFiles()]
    assert sum(f.stat().st_size for f in files) < 300_000
    assert d.count() == 400_000 and d.select("iid").distinct().count() == 20_000


@pytest.mark.parametrize("small", [True, False])
def test_matrices_of_sets_in_one_pass(spark, monkeypatch, small):
    if not small:
        for name, v in (("TILE", 8), ("MARKERS", 16), ("HELD", 2), ("SMALL", 16), ("LARGE", 16)):
            monkeypatch.setattr(relatedness, name, v)
    rng = np.random.default_rng(4)
    cells = [(i, j, int(rng.integers(0, 3)) if rng.random() < 0.8 else None) for i in range(21) for j in range(60) if (i, j % 2) != (3, 1)]
    g = spark.createDataFrame(cells, "iid long, sid long, gt int").repartition(4)
    got = rows(relatedness.grm_of_sets(g, F.col("sid") % 2, 2))
    one, two = (rows(relatedness.grm(g.where(F.col("sid") % 2 == k))) for k in (0, 1))
    assert set(got) == set(one) | set(two) and (3, 3) not in two
    for p, (n0, s0, n1, s1) in got.items():
        for (n, s), whole in (((n0, s0), one), ((n1, s1), two)):
            assert (n, s) == (0, 0) if p not in whole else n == whole[p][0] and s == pytest.approx(n * whole[p][1])


def test_two_matrices_are_not_joined_by_pair(spark, sf_dir):
    from lociflow.plans.fixture import fixture

    assert not re.search(r"Join.*i#.*j#", plan(catalog.a12_grm_subtract(fixture(spark, sf_dir))))


def test_pruning_shuffles_no_pair(spark, monkeypatch):
    a = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 4, 1.0), (2, 1, 0.3), (3, 2, 0.4), (4, 1, 0.01)], "i long, j long, value double")
    d = relatedness.prune(a, 0.05)
    joins = [line for line in plan(d).splitlines() if "Join" in line]
    assert joins and all("broadcast" in line for line in joins)
    assert {r.iid for r in d.collect()} == {2}
    monkeypatch.setattr(relatedness, "keep", None)  # no table of pairs is written
    assert {r.iid for r in relatedness.singletons(a, 0.05).collect()} == {4}


def test_runs_of_a_marker_hold_a_byte_a_call(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (6, 50)).astype(float)
    x[1, ::7] = np.nan
    x[2] = rng.random(50)
    x[3, 4], x[4, 5], x[5, 6] = 255, 254, -1
    cells = [(int(i), int(m), float(x[m, i]) if x[m, i] == x[m, i] else None) for m in range(6) for i in range(50) if (m, i) != (0, 9)]
    x[0, 9] = np.nan
    for order in (cells, [cells[k] for k in rng.permutation(len(cells))]):
        for parts in (1, 3):
            d = linkage.packed(spark.createDataFrame(order, "iid long, sid long, gt double").coalesce(1).repartition(parts))
            assert "places" in plan(d)
            got = {r.sid: np.array(r.x) for r in d.collect()}
            assert all(np.array_equal(got[m], x[m], equal_nan=True) for m in range(6))
    g = spark.createDataFrame([(i, m, int(v)) for m in (0, 4) for i, v in enumerate(np.nan_to_num(x[m])) if v < 3], "iid long, sid long, gt int")
    got = {r.sid: np.array(r.x) for r in linkage.packed(g, ids=np.arange(50)).collect()}
    assert got[0][9] == 0 and np.isnan(got[4][5]) and np.isnan(got[4]).sum() == 1
