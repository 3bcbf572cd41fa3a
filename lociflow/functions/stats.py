"""Distribution functions, false discovery rates and regressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lociflow.functions import ranks


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by its series or continued fraction."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_tail(x: float, df: float = 1.0) -> float:
    """P(X > x) of a chi-square; accurate far into the tail."""
    if x is None or math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    return math.erfc(math.sqrt(x / 2)) if df == 1 else math.exp(-x / 2) if df == 2 else gamma_upper(df / 2, x / 2)


def normal_quantile(p: float) -> float:
    """Upper-tail-safe quantile by Newton steps from a rational start."""
    if p <= 0 or p >= 1:
        return -math.inf if p <= 0 else math.inf
    t = math.sqrt(-2 * math.log(min(p, 1 - p)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    q = min(p, 1 - p)
    for _ in range(6):
        z += (normal_tail(z) - q) / (math.exp(-z * z / 2) / math.sqrt(2 * math.pi))
    return -z if p < 0.5 else z


def chi2_quantile(p: float, df: float = 1.0) -> float:
    """x with P(X > x) = p."""
    if df == 1:
        return normal_quantile(1 - p / 2) ** 2 if p > 1e-15 else _bisect(lambda x: chi2_tail(x, 1) - p)
    return _bisect(lambda x: chi2_tail(x, df) - p)


def _bisect(f, low: float = 0.0, high: float = 1.0) -> float:
    while f(high) > 0 and high < 1e6:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return (low + high) / 2


def beta_regularised(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularised(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(1000):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or 1e-300)
        c = 1 + n / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_regularised(df / 2, 0.5, df / (df + t * t))


def f_tail(x: float, d1: float, d2: float) -> float:
    """P(F > x)."""
    return beta_regularised(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def t_quantile(p: float, df: float) -> float:
    """t with P(|T| > t) = p."""
    return _bisect(lambda x: t_tail(x, df) - p)


def f_quantile(p: float, d1: float, d2: float) -> float:
    """x with P(F > x) = p."""
    return _bisect(lambda x: f_tail(x, d1, d2) - p)


def uniform_deviate(seed: int, *keys: str) -> Column:
    """A number in (0, 1) that seed and keys decide."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) + 0.5) / float(1 << 53)


def normal_deviate(seed: int, *keys: str) -> Column:
    """A standard normal number that seed and keys decide."""
    u, v = (uniform_deviate(seed, *keys, F.lit(k)) for k in (1, 2))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def gamma_deviate(shape: float, seed: int, *keys: str) -> Column:
    """A gamma number of unit scale that seed and keys decide; twice that of df / 2 is chi-square."""

    @F.pandas_udf(DoubleType())
    def draw(h: pd.Series) -> pd.Series:
        return h.map(lambda v: float(np.random.default_rng([seed, int(v)]).gamma(shape)))

    return draw(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)))


def chi2_deviate(df: float, seed: int, *keys: str) -> Column:
    return 2 * gamma_deviate(df / 2, seed, *keys)


def chi2_mixture_tail(x: float, weights: np.ndarray) -> float:
    """P(sum of weights * chi-square_1 > x): a saddle-point approximation, else matched moments."""
    w = np.asarray([v for v in weights if v > 1e-12])
    if not len(w) or x <= 0:
        return 1.0
    if len(w) == 1 or w.max() - w.min() < 1e-9 * w.max():
        return chi2_tail(x / w.mean(), len(w))
    mean, var = w.sum(), 2 * (w * w).sum()
    if abs(x - mean) > 1e-4 * math.sqrt(var):
        low, high = (-1e3 / w.max(), 0.0) if x < mean else (0.0, 0.5 / w.max() * (1 - 1e-12))
        slope = lambda s: (w / (1 - 2 * s * w)).sum() - x
        if slope(low) * slope(high) < 0:
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if slope(mid) < 0 else (low, mid)
            s = (low + high) / 2
            k = -0.5 * np.log1p(-2 * s * w).sum()
            second = 2 * (w * w / (1 - 2 * s * w) ** 2).sum()
            r = math.copysign(math.sqrt(max(2 * (s * x - k), 0)), s)
            v = s * math.sqrt(second)
            if r and v:
                p = normal_tail(r + math.log(v / r) / r)
                if 0 < p < 1:
                    return p
    scale = var / (2 * mean)
    return chi2_tail(x / scale, mean / scale)


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return x.map(lambda v: chi2_tail(v, 1.0) if v == v and v is not None else math.nan)


@F.pandas_udf(DoubleType())
def chi2_p2(x: pd.Series) -> pd.Series:
    """Upper tail with two degrees of freedom."""
    return x.map(lambda v: chi2_tail(v, 2.0))


def normal_tail_column(z: Column) -> Column:
    """P(Z > |z|) by a polynomial of absolute error 7.5e-8, for engines without erf; not for far tails."""
    a = F.abs(z)
    t = 1 / (1 + F.lit(0.2316419) * a)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    return F.exp(-a * a / 2) / F.sqrt(2 * F.pi()) * poly


def cauchy_combine(p: Column, weight: Column) -> Column:
    """Aggregate: combined p of p-values by Cauchy weights; tiny ones by the tail w / (p pi)."""
    p = F.greatest(p, F.lit(1e-300))
    t = F.sum(weight * F.when(p < 1e-15, 1 / (p * F.pi())).otherwise(F.tan((F.lit(0.5) - p) * F.pi()))) / F.sum(weight)
    return F.when(t > 1e15, 1 / (t * F.pi())).otherwise(F.lit(0.5) - F.atan(t) / F.pi())


def benjamini_hochberg(df: DataFrame, p: str, id_: str) -> DataFrame:
    """df with fdr: the least p * n / rank of this and all greater p-values, at most 1; null where p is null."""
    known = df.where(F.col(p).isNotNull())
    ranked = ranks.numbered(known, p, id_, name="r_").join(F.broadcast(known.agg(F.count("*").alias("n_"))))
    q = ranks.least_from_here(ranked.withColumn("q_", F.col(p) * F.col("n_") / (F.col("r_") + 1)), "q_", "r_", name="fdr")
    q = q.withColumn("fdr", F.least(F.lit(1.0), "fdr")).drop("r_", "n_", "q_")
    return q.unionByName(df.where(F.col(p).isNull()).withColumn("fdr", F.lit(None).cast("double")))


def null_share(df: DataFrame, p: str, at: float | None = None) -> float:
    """Share of true nulls. at: the share of p-values over this point, over its expectation (half: Zou's rule); without it
    Storey's: these shares at 0, 0.05 to 0.9, smoothed by a cubic, at the last. One aggregate counts all of them."""
    points = [at] if at is not None else [0.05 * k for k in range(19)]
    row = df.where(F.col(p).isNotNull()).agg(F.count("*").alias("n"), *[F.sum((F.col(p) >= x).cast("long")).alias(f"k{i}") for i, x in enumerate(points)]).first()
    if not row.n:
        return 1.0
    shares = np.array([row[f"k{i}"] / row.n / (1 - x) for i, x in enumerate(points)])
    last = shares[-1] if at is not None else np.polyval(np.polyfit(points, shares, 3), points[-1])
    return float(np.clip(last, 1e-6, 1))


def q_values(df: DataFrame, p: str, id_: str, share: float) -> DataFrame:
    """df with q: the false discovery rate times the share of true nulls, at most 1."""
    return benjamini_hochberg(df, p, id_).withColumn("q", F.least(F.lit(1.0), F.col("fdr") * share)).drop("fdr")


def pi0(p: np.ndarray, lambdas: np.ndarray = np.arange(0, 0.95, 0.05)) -> float:
    """Share of true nulls: a cubic fit over the tail shares, at its last point."""
    at = np.array([(p >= x).mean() / (1 - x) for x in lambdas])
    return float(np.clip(np.polyval(np.polyfit(lambdas, at, 3), lambdas[-1]), 1e-6, 1))


def storey(p: np.ndarray) -> np.ndarray:
    """q-values: Benjamini and Hochberg's times the share of nulls."""
    order = np.argsort(p)
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q * pi0(p), 1)
    return out


def regression(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Slope, its standard error, t, r and r2 of y on x by group, over rows with both."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = both.groupBy(*by).agg(F.count("*").alias("n"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("c"))
    s = s.where("n > 2 and vx > 0 and vy > 0")
    b = F.col("c") / F.col("vx")
    r2 = F.col("c") * F.col("c") / (F.col("vx") * F.col("vy"))
    se = F.sqrt(F.greatest(F.lit(0.0), (F.col("vy") - b * F.col("c")) * (F.col("n") - 1) / (F.col("n") - 2) / (F.col("vx") * (F.col("n") - 1))))
    return s.select(*by, "n", b.alias("b"), se.alias("se"), (b / se).alias("t"), (F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).alias("r"), r2.alias("r2"))


def inverse_normal(df: DataFrame, x: str) -> DataFrame:
    """df with z: the normal quantile of (rank - 1/2) / n; ties take the first rank, and null has none."""

    @F.pandas_udf(DoubleType())
    def quantile(p: pd.Series) -> pd.Series:
        return p.map(lambda v: None if pd.isna(v) else normal_quantile(v))

    ranked = ranks.first_ranks(df, x, "r_").join(F.broadcast(df.agg(F.count(x).alias("n_"))))
    return ranked.withColumn("z", quantile((F.col("r_") - 0.5) / F.col("n_"))).drop("r_", "n_")


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A natural cubic spline through (x, y), at other points."""
    n, h = len(x), np.diff(x)
    m = np.eye(n)
    r = np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    s = np.linalg.solve(m, r)
    k = np.clip(np.searchsorted(x, at) - 1, 0, n - 2)
    a, b = (x[k + 1] - at) / h[k], (at - x[k]) / h[k]
    return a * y[k] + b * y[k + 1] + ((a**3 - a) * s[k] + (b**3 - b) * s[k + 1]) * h[k] ** 2 / 6
