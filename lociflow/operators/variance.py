"""Variance components and spectra of relationship matrices, dense on the driver for bounded numbers of individuals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.functions.stats import chi2_tail
from lociflow.operators.relatedness import centred


@dataclass
class Reml:
    """Estimates: components (the last is the residual), their covariance, log likelihood, fixed effects, and V^-1."""

    theta: np.ndarray
    covariance: np.ndarray
    logl: float
    beta: np.ndarray
    inverse: np.ndarray
    p: np.ndarray
    converged: bool

    @property
    def vp(self) -> float:
        return float(self.theta.sum())

    def h2(self) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the components but the residual, and their errors by the delta method."""
        k = len(self.theta)
        share = self.theta / self.vp
        out = []
        for i in range(k - 1):
            d = -np.full(k, share[i] / self.vp)
            d[i] += 1 / self.vp
            out.append(np.sqrt(max(d @ self.covariance @ d, 0)))
        return share[:-1], np.array(out)


def bend(matrix: np.ndarray, share: float = 0.01) -> np.ndarray:
    """A relationship matrix without negative eigenvalues: these become small positive ones in the same order, namely the
    one nearest zero times the square of their distance from their sum, over that sum's square by share; then all are
    scaled to the trace that was. Matrices whose eigenvalues are all over 1e-6 come back as they are."""
    w, u = np.linalg.eigh(matrix)
    if w[0] > 1e-6:
        return matrix
    below = w < 0
    if below.any():
        total, least = w[below].sum(), -w[below].max()
        new = np.where(below, least * (total - w) ** 2 / (total * total / share + 1), w)
        w = new * (w.mean() / new.mean())
    return (u * w) @ u.T


def inverted(matrix: np.ndarray, least_rank: float = 0.99) -> tuple[np.ndarray, float, str]:
    """(inverse, log determinant, way) of a symmetric matrix by the first way that can: Cholesky, LU, QR, and, for a rank
    of at least least_rank of the size, the pseudo-inverse with the determinant of the part that has rank.

    A singular matrix may pass Cholesky by rounding: the inverse's trace, at least one over the least eigenvalue, then
    comes near one over the rounding errors of n additions, and the factor doesn't count."""
    n = len(matrix)
    rounding = n * np.finfo(float).eps
    try:
        half = np.linalg.cholesky(matrix)
        back = np.linalg.inv(half)
        if (back * back).sum() * np.diag(matrix).max(initial=0.0) * 64 * rounding < 1:
            return back.T @ back, 2 * float(np.log(np.diag(half)).sum()), "cholesky"
    except np.linalg.LinAlgError:
        pass
    w, u = np.linalg.eigh(matrix)
    size = np.abs(w)
    whole = size > rounding * size.max(initial=0.0)
    if whole.all():
        logdet = float(np.log(size).sum())
        if logdet >= np.log(1e-10):
            return np.linalg.inv(matrix), logdet, "lu"
        if logdet > np.log(1e-16):
            q, r = np.linalg.qr(matrix)
            return np.linalg.solve(r, q.T), logdet, "qr"
    if whole.sum() < least_rank * n:
        raise np.linalg.LinAlgError(f"a matrix of rank {whole.sum()} of {n} is not inverted: bend it first")
    return (u[:, whole] / w[whole]) @ u[:, whole].T, float(np.log(size[whole]).sum()), "rank"


def reml(y: np.ndarray, x: np.ndarray, matrices: list[np.ndarray], start: np.ndarray | None = None, fixed: bool = False, constrain: bool = True, rounds: int = 100, algorithm: str = "ai", weights: np.ndarray | None = None) -> Reml:
    """Restricted maximum likelihood of V = sum theta_k A_k + theta_e I: one expectation step, then average-information
    (or `fisher`, `em`) steps, shortened while the likelihood jumps; a negative component is set to 1e-6 of the phenotypic
    variance and its deficit spread over the others. fixed: evaluate at start alone. weights: of the individuals'
    residual variances, one for each, in place of I."""
    n, a = len(y), [*matrices, np.eye(len(y)) if weights is None else np.diag(np.asarray(weights, float))]
    k = len(a)
    vp = float(np.var(y - x @ np.linalg.lstsq(x, y, rcond=None)[0], ddof=1))
    theta = np.full(k, vp / k) if start is None else np.array(start, float)
    last, converged = -np.inf, fixed
    for step in range(1 if fixed else rounds + 1):
        v = sum(t * m for t, m in zip(theta, a))
        try:
            inverse, logdet, _ = inverted(v)
        except np.linalg.LinAlgError:
            inverse, logdet, _ = inverted(bend(v))
        vx = inverse @ x
        xvx = x.T @ vx
        p = inverse - vx @ np.linalg.solve(xvx, vx.T)
        py = p @ y
        logl = -0.5 * (logdet + np.linalg.slogdet(xvx)[1] + y @ py)
        apy = [m @ py for m in a]
        trace = np.array([(p * m).sum() for m in a])
        quad = np.array([py @ v_ for v_ in apy])
        score = 0.5 * (quad - trace)
        if algorithm == "fisher":
            pa = [p @ m for m in a]
            info = 0.5 * np.array([[(i * j.T).sum() for j in pa] for i in pa])
        else:
            papy = [p @ v_ for v_ in apy]
            info = 0.5 * np.array([[u @ w for w in papy] for u in apy])
        if step and (converged or abs(logl - last) < 1e-9 * max(1, abs(logl))):
            converged = True
            break
        if fixed:
            break
        if step == 0 or algorithm == "em":
            new = theta + theta * theta * (quad - trace) / n
        else:
            d = np.linalg.lstsq(info, score, rcond=None)[0]
            new = theta + (d * 0.316 if abs(logl - last) > 1 else d)
        if constrain:
            low = new < 1e-6 * vp
            if low.any() and not low.all():
                deficit = (1e-6 * vp - new[low]).sum()
                new[low] = 1e-6 * vp
                new[~low] = np.maximum(new[~low] - deficit / (~low).sum(), 1e-6 * vp)
        change = ((new - theta) ** 2).sum() / (new**2).sum()
        converged = change < 1e-8 and abs(logl - last) < 1e-4
        theta, last = new, logl
    return Reml(theta, np.linalg.pinv(info), logl, np.linalg.solve(xvx, vx.T @ y), inverse, p, converged)


def likelihood_ratio(full: Reml, y: np.ndarray, x: np.ndarray, kept: list[np.ndarray]) -> tuple[float, float]:
    """Ratio against a model with fewer components, and half the chi-square tail (by the number dropped)."""
    if kept:
        reduced = reml(y, x, kept).logl
    else:
        q, r = np.linalg.qr(x)
        res = y - q @ (q.T @ y)
        df = len(y) - x.shape[1]
        s2 = res @ res / df
        reduced = -0.5 * (len(y) * np.log(s2) + np.linalg.slogdet(x.T @ x / s2)[1] + df)
    lrt = max(2 * (full.logl - reduced), 0.0)
    return lrt, 0.5 * chi2_tail(lrt, len(full.theta) - 1 - len(kept)) if lrt > 0 else 0.5


def liability(h2: float, k: float, p: float) -> float:
    """Observed-scale h2 of a case-control sample (share p of cases) on the scale of liability for prevalence k."""
    from lociflow.functions.stats import normal_quantile

    t = normal_quantile(1 - k)
    z = np.exp(-t * t / 2) / np.sqrt(2 * np.pi)
    return float(h2 * (k * (1 - k) / z**2) * (k * (1 - k) / (p * (1 - p))))


def blup(model: Reml, matrices: list[np.ndarray], y: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Predicted effects of individuals for each component, residual last."""
    py = model.p @ y
    return [t * (a @ py) for t, a in zip(model.theta, [*matrices, np.eye(len(y))])]


def blup_leave_one_out(model: Reml, matrix: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Effects of the first component, each without its own phenotype: through the smoother's diagonal."""
    h = model.theta[0] * matrix @ model.p
    d = np.diag(h)
    return (h @ y - d * y) / (1 - d)


def marker_blup(g: DataFrame, ids: np.ndarray, py: np.ndarray, vg: float) -> DataFrame:
    """Effects of markers from the individuals' V^-1 residuals: sums of z * py, times Vg over the number of markers."""
    rows = F.broadcast(g.sparkSession.createDataFrame([(int(i), float(v)) for i, v in zip(ids, py)], "iid long, py double"))
    c = centred(g).join(rows, "iid")
    m = F.broadcast(c.agg(F.count_distinct("sid").alias("m")))
    s = c.groupBy("sid").agg(F.sum((F.col("gt") - F.col("mu")) / F.sqrt("var") * F.col("py")).alias("s"))
    return s.join(m).select("sid", (F.col("s") * vg / F.col("m")).alias("effect"))


def detect_families(matrix: np.ndarray, least: float = 1e-9) -> list[np.ndarray]:
    """Blocks of individuals that non-zero relationships connect."""
    n, label = len(matrix), np.arange(len(matrix))
    linked = np.abs(matrix) > least
    while True:
        new = np.array([label[linked[i]].min(initial=label[i]) for i in range(n)])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return [np.flatnonzero(label == v) for v in np.unique(label)]
        label = new


def sparse_reml(y: np.ndarray, matrix: np.ndarray, most_share: float = 1.6, grid: int = 101, refine: int = 12) -> tuple[float, float, float]:
    """Vg, Ve and log likelihood of V = Vg A + Ve I with Vg + Ve = Vp, by a grid of Vg refined around its best point. V
    falls into families, each solved by its own eigenvalues once."""
    yc = y - y.mean()
    vp = yc @ yc / (len(y) - 1)
    parts = []
    for f in detect_families(matrix):
        w, u = np.linalg.eigh(matrix[np.ix_(f, f)])
        parts.append((w, u.T @ yc[f], u.T @ np.ones(len(f))))
    w, yr, one = (np.concatenate(x) for x in zip(*parts))

    def logl(vg: float) -> float:
        v = vg * w + (vp - vg)
        if (v <= 0).any():
            return -np.inf
        xx = (one * one / v).sum()
        b = (one * yr / v).sum() / xx
        return float(-0.5 * (np.log(v).sum() + np.log(xx) + ((yr - b * one) ** 2 / v).sum()))

    low, high = 0.0, most_share * vp
    points = np.linspace(low, high, grid)
    for _ in range(refine + 1):
        values = [logl(v) for v in points]
        k = int(np.argmax(values))
        points = np.linspace(points[max(k - 1, 0)], points[min(k + 1, len(points) - 1)], 16)
    return float(points[np.argmax([logl(v) for v in points])]), float(vp - points[np.argmax([logl(v) for v in points])]), float(max(values))


def bivariate_reml(y1: np.ndarray, y2: np.ndarray, matrix: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, float]:
    """Components (V1, V2, C12, E1, E2, E12) of two traits on the same individuals, with the genetic correlation and its
    error by the delta method; the genetic part is bent back where it isn't positive definite."""
    n = len(y1)
    y = np.concatenate([y1, y2])
    x = np.kron(np.eye(2), np.ones((n, 1)))
    unit = [np.array(m, float) for m in ([[1, 0], [0, 0]], [[0, 0], [0, 1]], [[0, 1], [1, 0]])]
    a = [np.kron(u, matrix) for u in unit] + [np.kron(u, np.eye(n)) for u in unit]
    v1, v2 = np.var(y1, ddof=1), np.var(y2, ddof=1)
    theta = np.array([v1 / 2, v2 / 2, 0, v1 / 2, v2 / 2, 0.3 * np.cov(y1, y2)[0, 1]])

    def bent(t: np.ndarray) -> np.ndarray:
        """Variances above zero, and correlations within one."""
        t = t.copy()
        for i, j, c in ((0, 1, 2), (3, 4, 5)):
            t[i], t[j] = max(t[i], 1e-6 * v1), max(t[j], 1e-6 * v2)
            most = 0.999 * np.sqrt(t[i] * t[j])
            t[c] = np.clip(t[c], -most, most)
        return t

    def at(t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        v = sum(k * m for k, m in zip(t, a))
        inverse = np.linalg.inv(v)
        vx = inverse @ x
        xvx = x.T @ vx
        p = inverse - vx @ np.linalg.solve(xvx, vx.T)
        py = p @ y
        apy = [m @ py for m in a]
        logl = -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1] + y @ py)
        score = 0.5 * np.array([py @ u - (p * m).sum() for u, m in zip(apy, a)])
        return logl, score, 0.5 * np.array([[u @ (p @ w) for w in apy] for u in apy])

    theta = bent(theta)
    logl, score, info = at(theta)
    for _ in range(rounds):
        d = np.linalg.lstsq(info, score, rcond=None)[0]
        for step in 0.5 ** np.arange(12):  # the longest step that raises the likelihood
            new = bent(theta + step * d)
            found = at(new)
            if found[0] > logl:
                break
        if found[0] - logl < 1e-6:
            break
        theta, (logl, score, info) = new, found
    cov = np.linalg.pinv(info)
    rg = theta[2] / np.sqrt(theta[0] * theta[1])
    grad = np.array([-rg / (2 * theta[0]), -rg / (2 * theta[1]), 1 / np.sqrt(theta[0] * theta[1]), 0, 0, 0])
    return theta, float(rg), float(np.sqrt(max(grad @ cov @ grad, 0)))


def pca(ids: np.ndarray, matrix: np.ndarray, k: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues, greatest first, and the first k eigenvectors, signed so that each one's largest entry is positive."""
    w, u = np.linalg.eigh(matrix)
    w, u = w[::-1], u[:, ::-1][:, : min(k, len(ids))]
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    return w, u * sign


def pc_loadings(g: DataFrame, ids: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(sid, k, mu, loading): sums of z * eigenvector over eigenvalue and number of markers."""
    rows = [(int(i), k + 1, float(vectors[r, k])) for r, i in enumerate(ids) for k in range(vectors.shape[1])]
    v = F.broadcast(g.sparkSession.createDataFrame(rows, "iid long, k int, v double"))
    lam = F.broadcast(g.sparkSession.createDataFrame([(k + 1, float(x)) for k, x in enumerate(values[: vectors.shape[1]])], "k int, lam double"))
    c = centred(g)
    m = F.broadcast(c.agg(F.count_distinct("sid").alias("m")))
    s = c.join(v, "iid").groupBy("sid", "k", "mu").agg(F.sum((F.col("gt") - F.col("mu")) / F.sqrt("var") * F.col("v")).alias("s"))
    return s.join(lam, "k").join(m).select("sid", "k", "mu", (F.col("s") / (F.col("lam") * F.col("m"))).alias("loading"))


def project(g: DataFrame, loadings: DataFrame) -> DataFrame:
    """(iid, k, score) of individuals on loadings; missing calls count 0."""
    mu = F.col("mu")
    j = g.where("gt is not null").join(loadings, "sid")
    return j.groupBy("iid", "k").agg(F.sum((F.col("gt") - mu) / F.sqrt(mu * (1 - mu / 2)) * F.col("loading")).alias("score"))


def pair_table(y: DataFrame, a: DataFrame, traits: tuple[str, ...] = ("y",)) -> DataFrame:
    """Off-diagonal pairs (i, j, value) with each trait standardised: z_TRAIT_i and z_TRAIT_j."""
    m = F.broadcast(y.agg(*[f(t).alias(f"{k}_{t}") for t in traits for k, f in (("m", F.avg), ("s", F.stddev_samp))]))
    z = y.join(m).select("iid", *[((F.col(t) - F.col(f"m_{t}")) / F.col(f"s_{t}")).alias(t) for t in traits])
    side = lambda k: F.broadcast(z.select(F.col("iid").alias(k), *[F.col(t).alias(f"z_{t}_{k}") for t in traits]))  # noqa: E731  # a row an individual
    return a.where("i <> j").select("i", "j", "value").join(side("i"), "i").join(side("j"), "j")


def he_bivariate(y: DataFrame, a: DataFrame, one: str, two: str) -> DataFrame:
    """(response, intercept, slope): cross products of each trait with itself and of both, in either order, on the
    matrix, and the genetic correlation that the slopes give."""
    p = pair_table(y, a, (one, two))
    z = lambda t, k: F.col(f"z_{t}_{k}")
    rows = [("one", z(one, "i") * z(one, "j")), ("two", z(two, "i") * z(two, "j")), ("both", z(one, "i") * z(two, "j")), ("both", z(two, "i") * z(one, "j"))]
    each = p.select("value", F.explode(F.array(*[F.struct(F.lit(k).alias("response"), c.alias("c")) for k, c in rows])).alias("o"))
    return each.groupBy("o.response").agg(F.regr_intercept("o.c", "value").alias("intercept"), F.regr_slope("o.c", "value").alias("slope"))


def he_sparse(y: DataFrame, a: DataFrame, cutoff: float) -> DataFrame:
    """Regression of cross products on the relationships of at least the cutoff: vg, its error, and pairs."""
    p = pair_table(y, a).where(F.col("value") >= cutoff).select("value", (F.col("z_y_i") * F.col("z_y_j")).alias("c"))
    s = p.agg(F.count("*").alias("pairs"), F.regr_slope("c", "value").alias("vg"), F.regr_syy("c", "value").alias("syy"), F.regr_sxx("c", "value").alias("sxx"))
    return s.select("pairs", "vg", F.sqrt((F.col("syy") - F.col("vg") * F.col("vg") * F.col("sxx")) / ((F.col("pairs") - 2) * F.col("sxx"))).alias("se"))


@dataclass
class BinaryMixed:
    """A binary trait's mixed null model: variance of the random effect, fitted means, fixed effects and covariance P."""

    tau: float
    mu: np.ndarray
    alpha: np.ndarray
    p: np.ndarray | None


def fit_binary_mixed(y: np.ndarray, x: np.ndarray, matrix: np.ndarray, rounds: int = 20, grid: int = 51, refine: int = 6, covariance: bool = True) -> BinaryMixed:
    """Penalised quasi-likelihood: each round linearises the logistic model about the current effects and finds the random
    effect's variance by a refined grid of the restricted likelihood, until it moves by less than 5e-5 of itself. The weighted
    matrix is decomposed once a round, and a point of the grid is sums over its eigenvalues. covariance: make p."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ beta))
        w = np.maximum(mu * (1 - mu), 1e-10)
        step = np.linalg.solve((x * w[:, None]).T @ x, x.T @ (y - mu))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    eta, tau, zeros = x @ beta, 1.0, 0

    def spectrum(w: np.ndarray, z: np.ndarray):
        """Of V = (t S + 1), scaled by the root of w on either side: S's eigenvalues and vectors, x and z in its basis."""
        root = np.sqrt(w)
        s = matrix * root[:, None]
        s *= root
        values, vectors = np.linalg.eigh(s)
        return values, vectors, vectors.T @ (x * root[:, None]), vectors.T @ (z * root)

    def solve(t: float, w: np.ndarray, values: np.ndarray, xs: np.ndarray, zs: np.ndarray):
        d = t * values + 1
        xd = xs / d[:, None]
        xvx, xvz = xs.T @ xd, xd.T @ zs
        beta = np.linalg.solve(xvx, xvz)
        return -0.5 * (np.log(np.abs(d)).sum() - np.log(w).sum() + np.linalg.slogdet(xvx)[1] + zs @ (zs / d) - xvz @ beta), beta

    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-eta))
        w = np.maximum(mu * (1 - mu), 1e-10)
        z = eta + (y - mu) / w
        values, vectors, xs, zs = spectrum(w, z)
        points = np.linspace(0, 4 * max(tau, 0.25), grid)
        for _ in range(refine):
            k = int(np.argmax([solve(t, w, values, xs, zs)[0] for t in points]))
            points = np.linspace(points[max(k - 1, 0)], points[min(k + 1, len(points) - 1)], 9)
        new = float(points[len(points) // 2])
        beta = solve(new, w, values, xs, zs)[1]
        eta = x @ beta + new * matrix @ (np.sqrt(w) * (vectors @ ((zs - xs @ beta) / (new * values + 1))))
        zeros = zeros + 1 if new < 1e-6 else 0
        settled = abs(new - tau) < 5e-5 * max(new, 1e-6) or zeros >= 5
        tau = new
        if settled:
            break
    mu = 1 / (1 + np.exp(-eta))
    if not covariance:
        return BinaryMixed(tau, mu, beta, None)
    inverse = np.linalg.inv(tau * matrix + np.diag(1 / np.maximum(mu * (1 - mu), 1e-10)))
    vx = inverse @ x
    return BinaryMixed(tau, mu, beta, inverse - vx @ np.linalg.solve(x.T @ vx, vx.T))


def fixed_correlation_test(y1: np.ndarray, y2: np.ndarray, matrix: np.ndarray, rg: float = 0.0) -> tuple[float, float]:
    """Likelihood ratio (1 df) of the genetic correlation against a fixed value: the fit without the bound against the best
    fit whose covariance is rg times the root of both variances, found by coordinate steps."""
    n = len(y1)
    y, x = np.concatenate([y1, y2]), np.kron(np.eye(2), np.ones((n, 1)))
    w, u = np.linalg.eigh(matrix)
    ur = np.kron(np.eye(2), u.T)
    yr, xr = ur @ y, ur @ x

    def logl(t: np.ndarray) -> float:
        """In the matrix' eigenbasis V is 2 x 2 blocks."""
        a, d = w * t[0] + t[3], w * t[1] + t[4]
        c = w * t[2] + t[5]
        det = a * d - c * c
        if (det <= 0).any() or (a <= 0).any():
            return -np.inf
        inv = lambda v: np.concatenate([(d[:, None] * v[:n] - c[:, None] * v[n:]) / det[:, None], (a[:, None] * v[n:] - c[:, None] * v[:n]) / det[:, None]])
        vx, vy = inv(xr), inv(yr[:, None])
        xvx = xr.T @ vx
        b = np.linalg.solve(xvx, xr.T @ vy)
        return float(-0.5 * (np.log(det).sum() + np.linalg.slogdet(xvx)[1] + (yr @ vy)[0] - (b.T @ xr.T @ vy)[0, 0]))

    theta, _, _ = bivariate_reml(y1, y2, matrix)
    free = logl(theta)
    t, width = theta.copy(), 0.5
    fix = lambda v: np.concatenate([v[:2], [rg * np.sqrt(v[0] * v[1])], v[3:]])
    best = logl(fix(t))
    while width > 1e-4:
        moved = False
        for k in (0, 1, 3, 4, 5):
            for s in (1 + width, 1 / (1 + width)):
                new = t.copy()
                new[k] *= s
                if (v := logl(fix(new))) > best + 1e-9:
                    t, best, moved = new, v, True
        width = width if moved else width / 2
    lrt = max(2 * (free - best), 0.0)
    return lrt, chi2_tail(lrt)
