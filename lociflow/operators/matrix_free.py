"""Spectra, variance components and scans from products with a relationship matrix that no one place ever holds.

A Relationships multiplies A by a block of columns in one Spark pass: Markers as Z'(Z Q) / m over packed calls, Tiles over
the tiles of a table of pairs. The driver holds blocks of individuals by columns; everything else stays in tasks.

leading() finds the greatest eigenpairs by randomised block subspace iteration, with a Chebyshev filter between the
Rayleigh-Ritz steps. fit() finds variance components from Lanczos recurrences, whose quadrature gives the traces, log
determinants and quadratic forms for every ratio of the components from one set of passes. solve() applies V^-1 by
preconditioned conjugate gradients.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.functions.stats import chi2_tail
from lociflow.operators.association import null_markers
from lociflow.operators.linkage import packed

Store = Callable[[DataFrame], DataFrame]

#: Individuals of a piece of a product and of a tile, doubles that a task unpacks at once, parts that a task adds, and
#: doubles of all parts that the driver adds itself.
PIECE, TILE, HELD, FAN_IN, GATHERED = 1 << 15, 512, 1 << 22, 16, 1 << 23
PARTS = "slot long, piece int, v binary"


def added(parts: DataFrame, tasks: int, n: int, columns: int) -> np.ndarray:
    """Sum of products n x columns that tasks return in pieces of PIECE rows: rows (slot, piece, v). Pieces are added in
    groups of FAN_IN slots until the parts hold GATHERED numbers at most, or one part is left: no task holds more than
    FAN_IN pieces, and the driver gets GATHERED or n x columns numbers."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = None, []
        for batch in batches:
            held += zip(batch.column("slot").to_pylist(), batch.column("v").to_pylist())
        for _, v in sorted(held, key=lambda x: x[0]):
            total = np.frombuffer(v) if total is None else total + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "piece", "v"])

    while tasks > 1 and tasks * n * columns > GATHERED:
        parts = parts.groupBy(F.floor(F.col("slot") / FAN_IN).alias("slot_"), "piece").applyInArrow(add, PARTS)
        tasks = -(-tasks // FAN_IN)
    out = np.zeros((n, columns))
    for r in sorted(parts.collect(), key=lambda r: r.slot):
        out[r.piece * PIECE : (r.piece + 1) * PIECE] += np.frombuffer(r.v).reshape(-1, columns)
    return out


def pieces(total: np.ndarray) -> pa.RecordBatch:
    cut = [total[s : s + PIECE].tobytes() for s in range(0, len(total), PIECE)]
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())], ["slot", "piece", "v"])


class Relationships:
    """A symmetric matrix over ids, sorted; multiply() is one pass."""

    ids: np.ndarray

    def multiply(self, q: np.ndarray) -> np.ndarray:
        raise NotImplementedError


def unpacked(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(sids, z) of a batch of packed markers, z standardised with missing calls at 0, HELD numbers at a time."""
    step = max(1, HELD // max(n, 1))
    for s in range(0, batch.num_rows, step):
        part = batch.slice(s, step)
        calls = np.frombuffer(b"".join(part.column("calls").to_pylist()), np.float32).reshape(part.num_rows, n)
        mu, sd = (part.column(c).to_numpy()[:, None] for c in ("mu", "sd"))
        z = (calls - mu) / sd
        yield part.column("sid"), np.where(np.isnan(z), 0.0, z)


class Markers(Relationships):
    """Z'Z / m over all polymorphic markers of g(iid, sid, gt), z = (gt - mu) / sqrt(2pq), missing calls at the mean.

    pack() writes markers once to a table, 4 bytes a call; a pass reads it."""

    def __init__(self, table: DataFrame, ids: np.ndarray):
        """table: (sid, mu, sd, calls: floats over ids, nan where missing), written."""
        self.ids, self.table = np.asarray(ids, np.int64), table
        self.tasks, self.m = table.rdd.getNumPartitions(), table.count()

    @staticmethod
    def pack(g: DataFrame, store: Store, ids: np.ndarray | None = None) -> Markers:
        if ids is None:
            ids = np.sort(g.where("iid is not null").select(F.col("iid").cast("long")).distinct().toPandas()["iid"].to_numpy(np.int64))
        n = len(ids)

        def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                called = ~np.isnan(x)
                mu = np.divide(np.nansum(x, axis=1), called.sum(axis=1), out=np.zeros(len(x)), where=called.any(axis=1))
                var = mu * (1 - mu / 2)
                some = np.flatnonzero(var > 1e-50)
                calls = [x[k].astype(np.float32).tobytes() for k in some]
                yield pa.RecordBatch.from_arrays([batch.column("sid").take(pa.array(some)), pa.array(mu[some]), pa.array(np.sqrt(var[some])), pa.array(calls, pa.binary())], ["sid", "mu", "sd", "calls"])

        kept = g.join(F.broadcast(g.sparkSession.createDataFrame([(int(i),) for i in ids], "iid long")), "iid")  # 8 bytes an individual
        return Markers(store(packed(kept, ids=np.asarray(ids, np.int64)).select("sid", "x").mapInArrow(shrink, "sid long, mu double, sd double, calls binary")), ids)

    def multiply(self, q: np.ndarray) -> np.ndarray:
        n, sent = len(self.ids), self.table.sparkSession.sparkContext.broadcast(q)

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sent.value.shape)
            for batch in batches:
                for _, z in unpacked(batch, n):
                    total += z.T @ (z @ sent.value)
            yield pieces(total)

        out = added(self.table.mapInArrow(product, PARTS), self.tasks, *q.shape)
        sent.destroy()
        return out / max(self.m, 1)

    def by_marker(self, columns: np.ndarray, few: DataFrame | None = None) -> DataFrame:
        """(sid, mu, sd, zz, products array) of each marker: z'z and z'columns; of the markers of few(sid) only, if given."""
        n, sent = len(self.ids), self.table.sparkSession.sparkContext.broadcast(columns)

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for sids, z in unpacked(batch, n):
                    yield pa.RecordBatch.from_arrays([sids, *(batch.column(c).slice(at, len(sids)) for c in ("mu", "sd")), pa.array((z * z).sum(axis=1)), pa.array((z @ sent.value).tolist(), pa.list_(pa.float64()))], ["sid", "mu", "sd", "zz", "products"])
                    at += len(sids)

        table = self.table if few is None else self.table.join(F.broadcast(few), "sid", "left_semi")
        return table.select("sid", "mu", "sd", "calls").mapInArrow(product, "sid long, mu double, sd double, zz double, products array<double>")

    def rows(self, few: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """sids and z (individuals x markers) of a few markers, on the driver."""
        found = self.table.join(F.broadcast(few), "sid", "left_semi").orderBy("sid").select("sid", "mu", "sd", "calls").toArrow()
        z = [x for batch in found.to_batches() for _, x in unpacked(batch, len(self.ids))]
        return found["sid"].to_numpy(), np.vstack(z).T if z else np.zeros((len(self.ids), 0))


class Tiles(Relationships):
    """The matrix of a table of pairs a(i, j, value), j <= i, as tiles of TILE individuals, written by `store`."""

    def __init__(self, a: DataFrame, store: Store):
        spark = a.sparkSession
        self.ids = np.sort(a.where("i = j").select("i").toPandas()["i"].to_numpy(np.int64))
        sent = spark.sparkContext.broadcast(self.ids)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (np.searchsorted(sent.value, batch.column(c).to_numpy()) for c in ("i", "j"))
                yield pa.RecordBatch.from_arrays([pa.array(x // TILE), pa.array(y // TILE), pa.array((x % TILE * TILE + y % TILE).astype(np.int32)), batch.column("value")], ["t", "u", "at", "value"])

        def fill(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tile = np.zeros(TILE * TILE)
            for batch in batches:
                tile[batch.column("at").to_numpy()] = batch.column("value").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int64()), pa.array([tile.tobytes()], pa.binary())], ["t", "u", "tile"])

        cells = a.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("value").cast("double")).mapInArrow(place, "t long, u long, at int, value double")
        self.table = store(cells.groupBy("t", "u").applyInArrow(fill, "t long, u long, tile binary"))
        self.tasks = self.table.rdd.getNumPartitions()

    def multiply(self, q: np.ndarray) -> np.ndarray:
        n, sent = len(self.ids), self.table.sparkSession.sparkContext.broadcast(q)

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sent.value.shape)
            for batch in batches:
                for t, u, tile in zip(*(batch.column(c).to_pylist() for c in ("t", "u", "tile"))):
                    x, y = slice(t * TILE, min(n, t * TILE + TILE)), slice(u * TILE, min(n, u * TILE + TILE))
                    m = np.frombuffer(tile).reshape(TILE, TILE)[: x.stop - x.start, : y.stop - y.start]
                    if t == u:
                        m = m + np.tril(m, -1).T  # a diagonal tile holds its lower triangle
                    total[x] += m @ sent.value[y]
                    if t != u:
                        total[y] += m.T @ sent.value[x]
            yield pieces(total)

        out = added(self.table.mapInArrow(product, PARTS), self.tasks, *q.shape)
        sent.destroy()
        return out


@dataclass(frozen=True)
class Spectrum:
    """Greatest eigenvalues, unit eigenvectors as columns (each one's largest entry positive), residuals as shares of the
    greatest eigenvalue, and the passes taken."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int


def leading(a: Relationships, k: int, tolerance: float = 1e-9, degree: int = 10, rounds: int = 60, seed: int = 0) -> Spectrum:
    """The k greatest eigenpairs of a matrix whose other eigenvalues are at least about zero.

    A block of more columns than k is filtered by a Chebyshev polynomial that is small from zero to the block's least Ritz
    value and grows beyond it; QR and a Rayleigh-Ritz step follow, until the residuals of all k are under the tolerance."""
    n = len(a.ids)
    k = min(k, n)
    width = min(n, max(2 * k, k + 16))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    passes = 0
    for _ in range(rounds):
        y, passes = a.multiply(q), passes + 1
        h = q.T @ y
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        residuals = np.linalg.norm(y[:, :k] - q[:, :k] * values[:k], axis=0) / max(values[0], 1e-300)
        if width == n or residuals.max(initial=0.0) <= tolerance:
            break
        middle = max(values[-1], 1e-12 * values[0]) / 2  # of the interval that is damped, and half its length
        rate = first = middle / (values[0] - middle)
        before, now = q, (y - middle * q) * (rate / middle)
        for _ in range(degree - 1):
            next_rate = 1 / (2 / first - rate)
            new = (2 * next_rate / middle) * (a.multiply(now) - middle * now) - rate * next_rate * before
            before, now, rate, passes = now, new, next_rate, passes + 1
        q = np.linalg.qr(now)[0]
    else:
        raise RuntimeError(f"residuals stay at {residuals.max():.1e} after {passes} passes")
    vectors = q[:, :k]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return Spectrum(values[:k], vectors * np.where(sign == 0, 1, sign), residuals, passes)


def loadings(markers: Markers, found: Spectrum) -> DataFrame:
    """(sid, k, mu, loading) of each marker and component: z'v over the eigenvalue and the number of markers."""
    weights = found.vectors / (found.values * markers.m)
    return markers.by_marker(weights).select("sid", "mu", F.posexplode("products").alias("at", "loading")).select("sid", (F.col("at") + 1).alias("k"), "mu", "loading")


def without(x: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Takes the columns of x out of a block by least squares."""
    q = np.linalg.qr(x)[0]
    return lambda v: v - q @ (q.T @ v)


def lanczos(a: Relationships, seeds: np.ndarray, project: Callable[[np.ndarray], np.ndarray], steps: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, weights) of the quadrature of each seed's spectral measure under the projected matrix: seed' f(PAP) seed is
    the sum of weights times f(nodes). One pass a step for all seeds, each with a three-term recurrence of its own, whose
    vectors are kept orthogonal to the last two alone."""
    n, s = seeds.shape
    norm = np.linalg.norm(seeds, axis=0)
    now, before = seeds / np.maximum(norm, 1e-300), np.zeros_like(seeds)
    alpha, beta = [], []
    for _ in range(steps):
        w = project(a.multiply(now))
        alpha.append((now * w).sum(axis=0))
        w = w - now * alpha[-1] - (before * beta[-1] if beta else 0)
        beta.append(np.linalg.norm(w, axis=0))
        if (beta[-1] <= 1e-10 * max(np.abs(alpha).max(), 1e-300)).all():
            break
        before, now = now, w / np.maximum(beta[-1], 1e-300)
    out = []
    for c in range(s):
        d, e = np.array([v[c] for v in alpha]), np.array([v[c] for v in beta[:-1]])
        end = np.flatnonzero(e <= 1e-10 * max(np.abs(d).max(), 1e-300))  # an invariant subspace: what follows is noise
        m = end[0] + 1 if len(end) else len(d)
        nodes, u = np.linalg.eigh(np.diag(d[:m]) + np.diag(e[: m - 1], 1) + np.diag(e[: m - 1], -1))
        out.append((nodes, norm[c] ** 2 * u[0] ** 2))
    return out


@dataclass(frozen=True)
class Components:
    """Vg and Ve with their covariance, restricted log likelihood, that of Vg = 0, and the Monte-Carlo error of Vg / Vp
    that the probes leave."""

    vg: float
    ve: float
    covariance: np.ndarray
    logl: float
    logl_null: float
    probe_error: float

    @property
    def h2(self) -> tuple[float, float]:
        vp = self.vg + self.ve
        d = np.array([self.ve, -self.vg]) / vp**2
        return self.vg / vp, float(np.sqrt(max(d @ self.covariance @ d, 0.0)))

    @property
    def lrt(self) -> tuple[float, float]:
        v = max(2 * (self.logl - self.logl_null), 0.0)
        return v, 0.5 * chi2_tail(v) if v > 0 else 0.5


def fit(a: Relationships, y: np.ndarray, x: np.ndarray, probes: int = 30, steps: int = 60, seed: int = 1) -> Components:
    """Vg and Ve of y = x b + u + e, u ~ Vg A, by restricted likelihood on the complement of x, where V is Vg (PAP + d):
    y's own quadrature gives the quadratic forms at every d = Ve / Vg, those of random probes (signs, projected) the traces
    and the log determinant. So the likelihood is a function of one number on the driver, maximised there; its expected
    information gives the covariance. probe_error: what leaving out one probe at a time moves, as a jackknife."""
    n, df = len(y), len(y) - np.linalg.matrix_rank(x)
    project = without(x)
    u = project(y[:, None])
    signs = project(np.random.default_rng(seed).choice([-1.0, 1.0], size=(n, probes)))
    found = lanczos(a, np.hstack([u, signs]), project, steps)
    own, rest = found[0], found[1:]
    yy = float(own[1].sum())
    if df < 1 or yy <= 0:
        raise ValueError("the phenotype does not vary beside the covariates")

    def mean(f: Callable[[np.ndarray], np.ndarray], some: list) -> float:
        """Trace over the complement: each probe's form over its squared length, times the dimensions."""
        return df * float(np.mean([(w * f(t)).sum() / w.sum() for t, w in some]))

    def logl(d: float, some: list) -> float:
        q = float((own[1] / np.maximum(own[0] + d, 1e-12)).sum())
        vg = q / df
        return -0.5 * (df * np.log(vg) + mean(lambda t: np.log(np.maximum(t + d, 1e-12)), some) + df)

    def best(some: list) -> float:
        grid = np.exp(np.linspace(np.log(1e-3), np.log(1e6), 73))
        at = [logl(d, some) for d in grid]
        k = int(np.argmax(at))
        low, high = np.log(grid[max(k - 1, 0)]), np.log(grid[min(k + 1, len(grid) - 1)])
        for _ in range(60):  # golden section
            p, q = high - 0.6180339887498949 * (high - low), low + 0.6180339887498949 * (high - low)
            low, high = (p, high) if logl(float(np.exp(p)), some) < logl(float(np.exp(q)), some) else (low, q)
        return float(np.exp((low + high) / 2))

    d = best(rest)
    vg = float((own[1] / (own[0] + d)).sum()) / df
    ve = d * vg
    gg, ge, ee = (mean(lambda t, k=k: t**k / (t + d) ** 2, rest) / vg**2 for k in (2, 1, 0))
    info = 0.5 * np.array([[gg, ge], [ge, ee]])
    share = np.array([1 / (1 + best(rest[:k] + rest[k + 1 :])) for k in range(len(rest))]) if len(rest) > 1 else np.zeros(1)
    error = float(np.sqrt(((share - share.mean()) ** 2).sum() * (len(share) - 1) / len(share)))
    null = -0.5 * (df * np.log(yy / df) + df)
    shift = -0.5 * np.linalg.slogdet(x.T @ x)[1]
    return Components(vg, ve, np.linalg.pinv(info), logl(d, rest) + shift, null + shift, error)


def solve(a: Relationships, vg: float, ve: float, b: np.ndarray, top: Spectrum | None = None, tolerance: float = 1e-8, most: int = 500) -> np.ndarray:
    """V^-1 b by conjugate gradients, a pass a step for all columns. top: leading eigenpairs, which the preconditioner
    solves exactly, with the rest taken for its least eigenvalue's."""
    rest = ve + vg * (float(top.values[-1]) if top is not None and len(top.values) else 1.0)

    def precondition(r: np.ndarray) -> np.ndarray:
        if top is None:
            return r / rest
        c = top.vectors.T @ r
        return (r - top.vectors @ c) / rest + top.vectors @ (c / (ve + vg * top.values)[:, None])

    x, r = np.zeros_like(b), b.copy()
    z = precondition(r)
    p, rz, size = z.copy(), (r * z).sum(axis=0), np.maximum(np.linalg.norm(b, axis=0), 1e-300)
    for _ in range(most):
        if (np.linalg.norm(r, axis=0) <= tolerance * size).all():
            return x
        v = vg * a.multiply(p) + ve * p
        step = np.divide(rz, (p * v).sum(axis=0), out=np.zeros_like(rz), where=rz > 0)
        x, r = x + p * step, r - v * step
        z = precondition(r)
        new = (r * z).sum(axis=0)
        p, rz = z + p * np.divide(new, rz, out=np.zeros_like(rz), where=rz > 0), new
    raise RuntimeError(f"conjugate gradients leave {(np.linalg.norm(r, axis=0) / size).max():.1e} after {most} passes")


@dataclass(frozen=True)
class Projected:
    """P b of blocks for a fitted model: V^-1 b with the covariates taken out by generalised least squares."""

    a: Relationships
    vg: float
    ve: float
    x: np.ndarray
    vx: np.ndarray
    top: Spectrum | None

    @staticmethod
    def of(a: Relationships, vg: float, ve: float, x: np.ndarray, top: Spectrum | None = None) -> Projected:
        return Projected(a, vg, ve, x, solve(a, vg, ve, x, top), top)

    def __call__(self, b: np.ndarray) -> np.ndarray:
        vb = solve(self.a, self.vg, self.ve, b, self.top)
        return vb - self.vx @ np.linalg.solve(self.x.T @ self.vx, self.x.T @ vb)


def scan(markers: Markers, p: Projected, y: np.ndarray, count: int = 30, seed: int = 1, most_chi2: float = 5.0) -> DataFrame:
    """(sid, b, se, chi2, p) of every marker of a mixed model with covariates: z'Py over z'Pz, where z'Pz is z'Mz (z
    without the covariates) times the ratio that `count` null markers, picked by a hash, have on average; theirs is exact
    by conjugate gradients. b is by allele count; markers that the covariates explain give no row."""
    n = len(y)
    py = p(y[:, None])
    q = np.linalg.qr(p.x)[0]
    _, z = markers.rows(null_markers(markers.table, count, seed))
    pz = p(z)
    own, plain = (z * pz).sum(axis=0), (z * z).sum(axis=0) - ((q.T @ z) ** 2).sum(axis=0)
    some = (plain > 1e-9 * n) & (own > 0)
    chi2 = np.divide((z.T @ py)[:, 0] ** 2, own, out=np.zeros(len(own)), where=some)
    some &= chi2 < most_chi2
    if not some.any():
        raise ValueError("no null marker varies")
    ratio = float((own[some] / plain[some]).mean())
    products = markers.by_marker(np.hstack([py, q]))
    inside = F.aggregate(F.slice("products", 2, q.shape[1]), F.lit(0.0), lambda s, v: s + v * v)
    d = products.select("sid", "sd", F.col("products")[0].alias("zpy"), (F.col("zz") - inside).alias("zmz")).where(F.col("zmz") > 1e-9 * n)
    d = d.withColumn("zpz", F.col("zmz") * ratio)
    d = d.select("sid", (F.col("zpy") / F.col("zpz") / F.col("sd")).alias("b"), (1 / F.sqrt("zpz") / F.col("sd")).alias("se"), (F.col("zpy") * F.col("zpy") / F.col("zpz")).alias("chi2"))

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield t.assign(p=[chi2_tail(float(v)) for v in t["chi2"]])

    return d.mapInPandas(tails, "sid long, b double, se double, chi2 double, p double")
