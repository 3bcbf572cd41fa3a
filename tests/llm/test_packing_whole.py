"""Packing where every tail length occurs, as in large corpora."""

from collections import Counter

import numpy as np
import pytest

from lociflow.llm import packing

LAWS = {
    "real": None,
    "skewed": lambda r: r.lognormal(5.0, 1.1, 300_000),
    "short": lambda r: r.gamma(2.0, 150, 2_000_000),
    "uniform": lambda r: r.integers(0, 2048, 500_000),
    "few": lambda r: r.lognormal(5.0, 1.1, 3_000),
    "long": lambda r: r.normal(1500, 100, 20_000),
}


@pytest.mark.parametrize("law", LAWS)
def test_patterns_reach_the_bound(law, request):
    if law == "real":
        units = packing.encoded(request.getfixturevalue("spark").read.parquet("/root/testdata/sf0.1/documents.parquet"), *packing_files(), packing.CAPACITY)
        demand = {r["tail"]: 25 * r["count"] for r in units.where("tail > 0").groupBy("tail").count().collect()}
    else:
        lengths = LAWS[law](np.random.default_rng(1)).astype(int) % packing.CAPACITY
        demand = {s: n for s, n in Counter(lengths.tolist()).items() if s}
    plan = packing.cutting_stock(demand)
    used: Counter = Counter()
    for sizes, times in zip(plan.patterns, plan.times):
        assert sizes.sum() == packing.CAPACITY and times > 0
        for s in sizes.tolist():
            used[s] += times
    assert all(n <= demand[s] for s, n in used.items())
    # the linear program is within a ten thousandth of what no solution is below, at any law
    assert plan.bound <= plan.cost * (1 + 1e-9) and plan.cost - plan.bound <= 1e-4 * plan.cost
    tokens = sum(s * n for s, n in demand.items())
    assert plan.bound >= tokens / packing.CAPACITY * (1 - 1e-9)
    share = sum(used.values()) / sum(demand.values())
    print(law, len(demand), plan.rounds, (plan.cost - plan.bound) / plan.cost, share, sum(s * n for s, n in used.items()) / tokens)
    assert share >= {"real": 0.97, "skewed": 0.999, "short": 0.999, "uniform": 0.98, "few": 0.97, "long": 0.0}[law]


def packing_files():
    from lociflow.llm.queries import vocabulary

    return vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
