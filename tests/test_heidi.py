"""Forms of the test for instruments that act on the outcome beside the exposure, with such instruments planted."""

import numpy as np
import pytest

from lociflow.operators import heidi, summary

PLANTED = (4, 11, 23)


def instruments(seed=2, m=40, slope=0.3, extra=0.25):
    """Instruments in LD by neighbours, effects drawn with their errors; the planted ones act on the outcome as well."""
    rng = np.random.default_rng(seed)
    r = np.eye(m)
    for k in range(0, m - 1, 2):
        r[k, k + 1] = r[k + 1, k] = 0.2
    half = np.linalg.cholesky(r)
    x = rng.choice([-1, 1], m) * rng.uniform(0.15, 0.4, m)
    y = slope * x
    y[list(PLANTED)] += extra
    se = np.full(m, 0.015)
    return x + half @ rng.normal(size=m) * 0.015, se, y + half @ rng.normal(size=m) * 0.015, se, r


@pytest.mark.parametrize("form", ["mean", "top", "iterated"])
def test_planted_are_found_and_none_lost(form):
    for seed in range(5):
        a = instruments(seed)
        threshold = 1e-4  # forty tests
        out = summary.gsmr(*a, heidi_p=threshold, heidi=form)
        assert sorted(set(range(40)) - set(out["kept"].tolist())) == list(PLANTED)
        assert abs(out["bxy"] - 0.3) < 4 * out["se"]
        assert (out["global_p"] is not None and out["global_p"] >= 0.01) == (form == "iterated")


def test_the_global_test_finds_what_single_ones_do_not():
    x, sx, y, sy, r = instruments(7, extra=0.0)
    y = y + np.where(np.arange(40) % 2 == 0, 0.04, 0.0)  # each a little
    single = summary.gsmr(x, sx, y, sy, r, heidi_p=1e-12, heidi="iterated", global_p=0.0)
    both = summary.gsmr(x, sx, y, sy, r, heidi_p=1e-12, heidi="iterated", global_p=0.01)
    assert single["n"] == 40 and single["global_p"] < 0.01 <= both["global_p"] and both["n"] < 40


def test_departures_by_draws():
    """Without planted effects both p-values are uniform: of correlated differences too."""
    rng = np.random.default_rng(1)
    cov = np.full((6, 6), 0.3) + np.eye(6) * 0.7
    half, single, whole = np.linalg.cholesky(cov), [], []
    for _ in range(3000):
        p, w = heidi.departures(half @ rng.normal(size=6), cov, 2)
        assert p[2] == 1.0
        single.append(p[0])
        whole.append(w)
    for q in (0.01, 0.05, 0.5):
        assert np.mean(np.array(single) < q) == pytest.approx(q, abs=4 * np.sqrt(q / 3000))
        assert np.mean(np.array(whole) < q) == pytest.approx(q, abs=4 * np.sqrt(q / 3000) + 0.1 * q)


def test_tops():
    ratio = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])
    chi = np.array([99.0, 1, 1, 1, 5, 7, 1, 50, 60, 99])
    assert heidi.middle_top(ratio, chi) == 5
    assert heidi.fullest_top(ratio, chi, np.ones(10, bool)) in (7, 8)  # the outer twentieths hold the two of 99
    assert heidi.fullest_top(ratio, chi, ratio < 0.75) != 8
    assert heidi.fullest_top(ratio, chi, np.zeros(10, bool)) is None
    assert heidi.fullest_top(np.full(3, 0.5), np.array([1.0, 3, 2]), np.ones(3, bool)) == 1  # ties


def test_few_and_equal():
    one = (np.array([0.2]), np.array([0.01]), np.array([0.1]), np.array([0.01]))
    for form in ("top", "iterated"):
        out = summary.gsmr(*one, heidi=form)
        assert out["n"] == 1 and out["bxy"] == pytest.approx(0.5) and out["global_p"] is None
        same = summary.gsmr(*(np.repeat(v, 4) for v in one), r=np.full((4, 4), 1.0), heidi=form)
        assert same["n"] == 4
    with pytest.raises(ValueError):
        summary.gsmr(*one, heidi="sideways")
