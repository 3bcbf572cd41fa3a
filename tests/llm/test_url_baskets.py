"""What FP-growth of the URL rules is given, and that either form of baskets gives the same rules."""

import random

from lociflow.llm import url_rules


def held(spark):
    rng = random.Random(5)
    rows = [(sorted(rng.sample([f"p:{c}" for c in "abcdefgh"], rng.randint(1, 5))), rng.choice(["allow", "block", "block"])) for _ in range(80)]
    return spark.createDataFrame([*rows, ([], "allow")], "classes array<string>, verdict string")


def test_baskets_are_whole_urls(spark, monkeypatch):
    seen = []

    class Watched(url_rules.FPGrowth):
        def fit(self, items):
            seen.extend(r["items"] for r in items.collect())
            return super().fit(items)

    monkeypatch.setattr(url_rules, "FPGrowth", Watched)
    d = held(spark)
    rules = url_rules.mine(d, 80, 5).collect()
    assert sorted(seen) == sorted([*r.classes, "=" + r.verdict] for r in d.collect() if r.classes)
    assert {len(r.needs) for r in rules} == {1, 2}


def test_either_form_gives_the_same_rules(spark, monkeypatch):
    d = held(spark)
    key = lambda rows: sorted((r.needs, r.verdict, round(r.confidence, 12), round(r.support, 12)) for r in rows)
    one = key(url_rules.mine(d, 80, 5).collect())
    monkeypatch.setattr(url_rules, "WIDEST", 1)
    assert one and one == key(url_rules.mine(d, 80, 5).collect())
