"""Whitening of embeddings by matrix-free block subspace iteration.

Vectors become whole numbers; sums over the distinct ones are exact. A Spark pass sends an orthonormal block Q to the
tasks, which return X'(XQ) of their centred rows; the driver, which holds two blocks of dimensions by columns, takes QR
and Rayleigh-Ritz steps until the residual of every wanted component is at the rounding of a double. Where the block
converges slowly (the spectrum is flat beyond it), it is doubled, up to all dimensions, when one pass is enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import discard, materialise, tree_sum

#: Columns of the first block and of the largest, passes after which a block is doubled unless it is near its end, and
#: passes at most.
BLOCK, WIDEST, PATIENCE, PASSES = 16, 512, 8, 2000
#: Residuals that count as converged, and eigenvalues that count as zero, as shares of the greatest eigenvalue.
RESIDUAL, ZERO = 2e-15, 1e-12


@dataclass(frozen=True)
class Spectrum:
    """The fit: rows, exact sums of each dimension, eigenvalues of the covariance with unit eigenvectors as columns, its
    trace, residuals as shares of the greatest eigenvalue, and the passes taken."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_numbers(vector: str = "embedding", scale: int = 256) -> Column:
    """array<long> of floor(scale * entry), null where the vector is null or holds null or non-finite entries. Entries
    beyond a long's range stand at its ends."""
    v = F.col(vector)
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.when(v.isNotNull() & ~F.coalesce(odd, F.lit(True)), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension; a task sums in longs where they can't overflow."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = matrix(batch.column(0), d)
            if not len(x):
                continue
            n += len(x)
            most = max(abs(int(x.max())), abs(int(x.min())))
            part = x.sum(axis=0) if most * len(x) < 2**62 else x.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))], ["at", "s"])

    rows = fit.select("x").mapInArrow(add, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()
    found = {r["at"]: int(r.s) for r in rows}
    return found.get(-1, 0), [found.get(k, 0) for k in range(d)]


def passed(fit: DataFrame, tasks: int, mean: np.ndarray, block: np.ndarray, own: bool = False) -> np.ndarray:
    """One pass: sum over rows of (x - mean)(x - mean)'block, or (own) of the rows' own w'w, w = (x - mean)'block, with
    w's sums as the last row."""
    d = len(mean)
    sent = fit.sparkSession.sparkContext.broadcast((mean, block))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, block = sent.value
        total = np.zeros((block.shape[1] + 1, block.shape[1]) if own else block.shape)
        for batch in batches:
            x = matrix(batch.column(0), d)
            for s in range(0, len(x), 8192):
                c = x[s : s + 8192] - mean
                w = c @ block
                if own:
                    total[:-1] += w.T @ w
                    total[-1] += w.sum(axis=0)
                else:
                    total += c.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["slot", "v"])

    out = tree_sum(fit.select("x").mapInArrow(multiply, "slot long, v binary"), tasks)
    sent.destroy()
    return out.reshape(-1, block.shape[1])


def spectrum(fit: DataFrame, d: int, k: int, seed: int = 0) -> Spectrum:
    """The k greatest eigenvalues with eigenvectors (fewer, if fewer are above zero) of the covariance (divisor n) of
    fit (x array<long> of d entries)."""
    n, sums = exact_sums(fit, d)
    none = Spectrum(n, tuple(sums), np.zeros(0), np.zeros((d, 0)), 0.0, np.zeros(0), 0)
    if not n or not d:
        return none
    tasks = fit.rdd.getNumPartitions()
    mean = np.array([s / n for s in sums])
    rng = np.random.default_rng(seed)
    k, width = min(k, d), min(d, max(BLOCK, 2 * k))
    q = np.linalg.qr(rng.normal(size=(d, width)))[0]
    history: list[float] = []
    for step in range(1, PASSES + 1):
        y = passed(fit, tasks, mean, q) / n
        h = q.T @ y
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        z, y = q @ turn, y @ turn
        greatest = max(values[0], 0.0)
        if greatest <= 0:
            return none
        residuals = np.linalg.norm(y - z * values, axis=0)[:k] / greatest
        worst = float(residuals[values[:k] > ZERO * greatest].max(initial=0.0))
        history.append(worst)
        floor = RESIDUAL * math.sqrt(d)
        stalled = len(history) > 3 and worst < 1e-12 and worst > 0.5 * max(history[-4:-1])
        if width == d or worst <= floor or stalled:
            break
        if len(history) >= PATIENCE and width < min(d, WIDEST):
            fall = (history[-1] / history[-4]) ** (1 / 3)
            if fall >= 1 or math.log(floor / worst) / math.log(fall) > PATIENCE:
                wider = min(d, 2 * width, WIDEST)
                y = np.hstack([y, rng.normal(size=(d, wider - width)) * np.linalg.norm(y[:, -1])])
                width, history = wider, []
        q = np.linalg.qr(y)[0]
    else:
        raise RuntimeError(f"residuals stay at {worst:.1e} of the greatest eigenvalue after {PASSES} passes")
    whole = values[:k] > ZERO * greatest
    trace = float(values.sum()) if width == d else total_variance(fit, tasks, mean) / n
    return Spectrum(n, tuple(sums), values[:k][whole], z[:, :k][:, whole], trace, residuals[whole], step)


def total_variance(fit: DataFrame, tasks: int, mean: np.ndarray) -> float:
    """Sum of squared distances from the mean, a pass of its own."""
    d, sent = len(mean), fit.sparkSession.sparkContext.broadcast(mean)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((float(((matrix(b.column(0), d) - sent.value) ** 2).sum()) for b in batches), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.array([total]).tobytes()], pa.binary())], ["slot", "v"])

    return float(tree_sum(fit.select("x").mapInArrow(add, "slot long, v binary"), tasks)[0])


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sum over dimensions of (n x - S)^2 of each row; None where it exceeds a long."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums)) if x.size else 0
    if most < 2**31 and len(sums) * most * most < 2**63:
        off = n * x - np.array(sums, dtype=np.int64)
        return (off * off).sum(axis=1).tolist()
    whole = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in whole]


def fit_list(rows: DataFrame) -> tuple[DataFrame, int]:
    """Distinct x of the commonest length of rows (x array<long>), written, and that length (0 if there are none)."""
    lengths = rows.where("x is not null and size(x) > 0").groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    d = int(top.d) if top else 0
    return materialise(rows.where(F.size("x") == d).select("x").distinct()), d


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each row of vectors (vec_id,
    embedding) and each component, from 1 to `components`.

    Rows whose vector is null or holds null or non-finite entries give no rows. Vectors have one length; should they not,
    those of other lengths than the commonest (of two, the longer) give no rows either, nor do empty vectors. There are as
    many components as eigenvalues above zero: none if all vectors are equal. Repeated rows and null vec_id give rows of
    their own. deviation is null where it exceeds a long. An empty table gives no rows; other columns aren't read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers().alias("x"))
    fit, d = fit_list(rows)
    found = spectrum(fit, d, components)
    k = len(found.values)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    turn = found.vectors / np.sqrt(found.values)
    own = passed(fit, fit.rdd.getNumPartitions(), found.mean, turn, own=True) / found.n
    error = float(np.abs(own[:-1] - np.outer(own[-1], own[-1]) - np.eye(k)).max())
    discard(fit)
    explained = found.values / found.trace
    sent = vectors.sparkSession.sparkContext.broadcast((found.n, found.sums, found.mean, turn, explained, error))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, mean, turn, explained, error = sent.value
        for batch in batches:
            x = matrix(batch.column(1), d)
            if not len(x):
                continue
            w = (x - mean) @ turn
            at = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)), pa.array(deviations(x, n, sums), pa.int64()).take(at), pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == d).mapInArrow(project, schema)
