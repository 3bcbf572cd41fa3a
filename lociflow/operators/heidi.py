"""Instruments that act on an outcome beside the exposure: their ratio of effects departs from that of a top instrument.

Instruments of one pair of traits are few (one a clump); these are small arrays.
"""

from __future__ import annotations

import numpy as np

from lociflow.functions.stats import chi2_mixture_tail, chi2_tail

#: An instrument whose chi-square on the outcome reaches this (p < 5e-8) can't be the global test's top.
OUTCOME = 29.7168


def ratio_covariance(bzx: np.ndarray, bzx_se: np.ndarray, bzy: np.ndarray, bzy_se: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Covariance of bzy / bzx over instruments: errors of the outcome and, at each one's own ratio, of the exposure."""
    y, x = bzy_se / bzx, bzx_se * bzy / (bzx * bzx)
    return r * (np.outer(y, y) + np.outer(x, x))


def middle_top(ratio: np.ndarray, chi: np.ndarray) -> int:
    """The instrument of the greatest chi-square among the ratios of the middle fifth."""
    low, high = np.quantile(ratio, [0.4, 0.6])
    return int(np.argmax(np.where((ratio >= low) & (ratio <= high), chi, -1)))


def fullest_top(ratio: np.ndarray, chi: np.ndarray, may: np.ndarray) -> int | None:
    """The instrument of the greatest chi-square in the fifth of the ratios whose mean chi-square is the greatest, of
    those that may be it and whose ratio isn't in the outer twentieths. The greatest ratio belongs to no fifth, unless it
    is all that there is; None where none may be it."""
    if not may.any():
        return None
    low, high = np.quantile(ratio[may], [0.05, 0.95])
    may = np.flatnonzero(may & (ratio >= low) & (ratio <= high))
    if not len(may):
        return None
    edges = np.quantile(ratio[may], np.linspace(0, 1, 6))
    fifths = [may[(ratio[may] >= a) & (ratio[may] < b)] for a, b in zip(edges, edges[1:])]
    best = max(fifths, key=lambda k: chi[k].mean() if len(k) else -1.0)
    best = best if len(best) else may
    return int(best[np.argmax(chi[best])])


def departures(ratio: np.ndarray, cov: np.ndarray, top: int) -> tuple[np.ndarray, float]:
    """(p of each instrument's difference from the top's ratio, p of all differences together). The sum of squares over
    variances of correlated differences is a mixture of chi-squares, weighted by their correlations' eigenvalues."""
    d = ratio - ratio[top]
    var = cov + cov[top, top] - cov[:, [top]] - cov[[top], :]
    v = np.diag(var)
    told = v > 1e-12 * cov.diagonal().max()  # not of the top and of copies of it, whose difference has no variance
    chi = np.where(told, d * d / np.where(told, v, 1.0), np.where(np.abs(d) > 1e-9 * abs(ratio[top]), np.inf, 0.0))
    p = np.array([chi2_tail(float(c)) if c < np.inf else 0.0 for c in chi])
    if not told.any() or np.isinf(chi).any():
        return p, float(p.min())
    corr = var[np.ix_(told, told)] / np.sqrt(np.outer(v[told], v[told]))
    np.fill_diagonal(corr, 1.0)
    return p, chi2_mixture_tail(float(chi.sum()), np.linalg.eigvalsh(corr))


def against_top(ratio: np.ndarray, chi: np.ndarray, cov: np.ndarray, least_p: float) -> np.ndarray:
    """Instruments left by one pass: those that don't depart from the middle's top at p < least_p."""
    top = middle_top(ratio, chi)
    p, _ = departures(ratio, cov, top)
    return np.flatnonzero((p >= least_p) | (np.arange(len(ratio)) == top))


def iterated(ratio: np.ndarray, chi: np.ndarray, outcome: np.ndarray, cov: np.ndarray, least_p: float, global_p: float, least: int = 2) -> tuple[np.ndarray, float | None]:
    """(instruments left, p of the global test). The one that departs most from the top goes, and the top is chosen anew,
    until none departs at p < least_p; then likewise while all together depart at p < global_p, the top being none of
    strong effect on the outcome (chi-square). Ends, without a p, where fewer than `least` are left or none may be top."""
    kept = np.arange(len(ratio))
    weak = outcome < OUTCOME
    for together in (False, True):
        while len(kept) >= max(least, 1):
            may = weak[kept] if together else np.ones(len(kept), bool)
            top = fullest_top(ratio[kept], chi[kept], may)
            if top is None:
                return kept, None
            p, whole = departures(ratio[kept], cov[np.ix_(kept, kept)], top)
            if (whole >= global_p) if together else (p.min() >= least_p):
                break
            kept = np.delete(kept, int(np.argmin(p)))
        else:
            return kept, None
    return kept, whole
