"""Selection, joint and conditional analyses, and shrunken effects of summary rows over sparse LD.

Markers lie in the order (chr, bp, sid). A region ends where no LD pair spans the next place, so regions don't touch each
other and are worked on in parallel; small ones share a task. A region's LD is rows of its own pairs: its memory is that
of the pairs (about 40 bytes each), and no array of markers by markers is made. What the analyses hold beside it is as
many sparse rows as markers are in the model.

s: (sid, b, se, freq, n_eff, v); v is the reference variance of a marker. pairs: (sid1, sid2, r), each pair once, of one
chromosome. Markers of s that snp lacks, pairs of other markers, and pairs without r take no part; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.functions import ranks
from lociflow.functions.stats import chi2_tail
from lociflow.plans.storage import keep

#: Pairs in one run of a task, and places whose regions share a task.
RUN, PLACES = 1_000_000, 4096
#: A set of markers is collinear where the root of its correlations' condition number is over this.
CONDITION = 30.0


class Band:
    """Summary rows of one region and its correlations, row by row: places and values of a marker's partners."""

    def __init__(self, rows: pd.DataFrame, i: np.ndarray, j: np.ndarray, r: np.ndarray, vp: float = 1.0) -> None:
        self.sid, self.b, self.se, self.n = (rows[k].to_numpy() for k in ("sid", "b", "se", "n_eff"))
        f = rows["freq"].to_numpy()
        self.h, self.vp, m = 2 * f * (1 - f), vp, len(rows)
        self.d = self.h * self.n
        own = np.arange(m)
        at = np.concatenate([i, j, own])
        order = np.argsort(at, kind="stable")
        self.ends = np.searchsorted(at[order], np.arange(m + 1))
        self.to = np.concatenate([j, i, own])[order]
        self.r = np.concatenate([r, r, np.ones(m)])[order]

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.ends[k], self.ends[k + 1])
        return self.to[s], self.r[s]

    def among(self, chosen: list[int]) -> np.ndarray:
        """Correlations of a few markers."""
        at = {k: x for x, k in enumerate(chosen)}
        out = np.zeros((len(chosen), len(chosen)))
        for x, k in enumerate(chosen):
            to, r = self.row(k)
            for t in np.nonzero(np.isin(to, chosen))[0]:
                out[x, at[int(to[t])]] = r[t]
        return out

    def collinear(self, chosen: list[int], most: float) -> bool:
        r = self.among(chosen)
        w = np.linalg.eigvalsh(r)
        return w[0] <= 0 or np.sqrt(w[-1] / w[0]) > CONDITION or (1 - 1 / np.diag(np.linalg.inv(r))).max() > most

    def times(self, x: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """The product of r min(n, n'), with another diagonal, and a vector."""
        at = np.repeat(np.arange(len(x)), np.diff(self.ends))
        a = np.where(at == self.to, diagonal[at], self.r * np.minimum(self.n[at], self.n[self.to]))
        return np.add.reduceat(a * x[self.to], self.ends[:-1])


class Model:
    """Markers in a joint model of a band, and every marker's effect given them.

    Two Cholesky factors grow by a row with each marker that enters: of the correlations, whose squares say how much of a
    marker the model tells, and of the model's own products, whose rows take its part out of the effects. A row is sparse:
    it reaches as far as the chain of the model's markers in LD."""

    def __init__(self, band: Band) -> None:
        self.band = band
        self.clear()

    def clear(self) -> None:
        self.chosen: list[int] = []
        self.bc, self.told = self.band.b.copy(), np.zeros(len(self.band.b))
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # places, rows of both factors
        self.y: list[float] = []

    def enter(self, c: int) -> bool:
        """Whether the marker could enter: not where the products with it aren't positive, as of copies of others."""
        g = self.band
        to, r = g.row(c)
        w, v = np.zeros((2, len(g.b)))
        w[to], v[to] = r, r * np.minimum(g.n[c], g.n[to]) * np.sqrt(g.h[c] * g.h[to])
        v[c], y, reach = g.d[c], g.d[c] * g.b[c], [to]
        for (at, wr, vr), before in zip(self.rows, self.y):
            k = np.searchsorted(at, c)
            if k == len(at) or at[k] != c:
                continue
            y -= vr[k] * before
            w[at] -= wr * wr[k]
            v[at] -= vr * vr[k]
            reach.append(at)
        if w[c] <= 1e-10 or v[c] <= 1e-10 * g.d[c]:
            return False
        at = np.unique(np.concatenate(reach))
        wr, vr = w[at] / np.sqrt(w[c]), v[at] / np.sqrt(v[c])
        self.y.append(y / np.sqrt(v[c]))
        self.rows.append((at, wr, vr))
        self.chosen.append(c)
        self.told[at] += wr * wr
        self.bc[at] -= vr * self.y[-1] / g.d[at]
        return True

    def take(self, markers) -> Model:
        """The model with all of the markers; an error if one is a combination of others."""
        for c in markers:
            if not self.enter(int(c)):
                raise ValueError(f"marker {self.band.sid[c]} is a combination of others of the joint model")
        return self

    def leave(self, k: int) -> None:
        rest = [c for c in self.chosen if c != k]
        self.clear()
        self.take(rest)

    def chi(self, most: float) -> np.ndarray:
        """Chi-squares given the model; -1 for its markers and what it nearly tells."""
        out = self.bc**2 * self.band.d / self.band.vp if self.chosen else (self.band.b / self.band.se) ** 2
        out = np.nan_to_num(out, nan=-1)
        out[self.told >= most] = -1
        out[self.chosen] = -1
        return out

    def joint(self) -> tuple[np.ndarray, np.ndarray]:
        """Joint effects and errors of the model's markers, in their order of entry."""
        k = len(self.chosen)
        low = np.zeros((k, k))
        for x, (at, _, vr) in enumerate(self.rows):
            has = np.isin(self.chosen[x:], at)
            low[x:, x][has] = vr[np.searchsorted(at, np.array(self.chosen[x:])[has])]
        inverse = np.linalg.solve(low, np.eye(k))
        return inverse.T @ np.array(self.y), np.sqrt((inverse * inverse).sum(axis=0) * self.band.vp)

    def worst(self) -> tuple[int, float]:
        b, se = self.joint()
        k = int(np.argmin((b / se) ** 2))
        return self.chosen[k], chi2_tail(float((b[k] / se[k]) ** 2))


def stepwise(band: Band, most_p: float, most: float, way: str = "stepwise", top: int | None = None, steps: int | None = None) -> tuple[Model, list[tuple[float, int]]]:
    """The model and, for each step that brought a marker in, its chi-square and by how much the model grew.

    `stepwise`: in by the least conditional p, after each out by the greatest joint p; `forward`: in alone; `backward`:
    all in, then out. top: stop at so many markers; steps: stop after so many entries."""
    model, taken, barred = Model(band), [], set()
    if way == "backward":
        thin(model.take(range(len(band.b))), most_p, set())
        return model, []
    while (top is None or len(model.chosen) < top) and (steps is None or len(taken) < steps):
        chi = model.chi(most)
        chi[list(barred)] = -1
        k = int(np.argmax(chi)) if len(chi) else -1
        if k < 0 or chi[k] < 0 or chi2_tail(float(chi[k])) > most_p:
            break
        if model.chosen and band.collinear([*model.chosen, k], most):
            barred.add(k)
            continue
        size = len(model.chosen)
        if not model.enter(k):
            barred.add(k)
            continue
        if way == "stepwise":
            thin(model, most_p, barred)
        taken.append((float(chi[k]), len(model.chosen) - size))
    return model, taken


def thin(model: Model, most_p: float, barred: set[int]) -> None:
    """Take out the marker of the greatest joint p until none is over most_p; the last one stays."""
    while len(model.chosen) > 1:
        k, p = model.worst()
        if p <= most_p:
            break
        model.leave(k)
        barred.add(k)


def placed(s: DataFrame, pairs: DataFrame, snp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(markers, runs): s with chr, place, region (the place of its first marker) and bag; and the pairs of each bag as
    runs of places from the bag's first and values, made in the tasks before their shuffle."""
    m = keep(ranks.numbered(s.join(snp.select("sid", "chr", "bp"), "sid"), "chr", "bp", "sid"))
    side = lambda k: m.select(F.col("sid").alias(f"sid{k}"), F.col("place").alias(f"p{k}"))
    p = pairs.where("r <> 0 and not isnan(r)").join(side(1), "sid1").join(side(2), "sid2")
    p = keep(p.select(F.least("p1", "p2").alias("i"), F.greatest("p1", "p2").alias("j"), "r").where("i <> j"))
    far = p.groupBy(F.col("i").alias("place")).agg(F.max("j").alias("far"))
    reach = ranks.greatest_before(m.join(far, "place", "left"), "far", "place", name="reach")
    starts = reach.withColumn("own", F.when(F.col("reach").isNull() | (F.col("reach") < F.col("place")), F.col("place")))
    r = ranks.greatest_before(starts, "own", "place", name="last")
    region = F.coalesce("own", "last")
    markers = keep(r.withColumn("region", region).withColumn("bag", F.floor(region / PLACES)).drop("far", "reach", "own", "last"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bag = batch.column("bag").to_numpy()
            order = np.argsort(bag, kind="stable")
            i, j, v = (batch.column(k).to_numpy()[order] for k in ("i", "j", "r"))
            names, first = np.unique(bag[order], return_index=True)
            cut = [(int(b), k, min(k + RUN, e)) for b, s_, e in zip(names, first, [*first[1:], len(bag)]) for k in range(s_, e, RUN)]
            yield pa.RecordBatch.from_pydict({"bag": [b for b, _, _ in cut], "i": [i[s:e].tobytes() for _, s, e in cut], "j": [j[s:e].tobytes() for _, s, e in cut], "r": [v[s:e].tobytes() for _, s, e in cut]}, schema=pa.schema([("bag", pa.int64()), ("i", pa.binary()), ("j", pa.binary()), ("r", pa.binary())]))

    of = markers.select(F.col("place").alias("i"), "bag")
    return markers, p.join(of, "i").select("bag", "i", "j", F.col("r").cast("double").alias("r")).mapInArrow(gather, "bag long, i binary, j binary, r binary")


def by_region(markers: DataFrame, runs: DataFrame, vp: float, work: Callable[[pd.DataFrame, Band], pd.DataFrame], schema: str) -> DataFrame:
    """work(rows, band) of each region, rows sorted by place; bags of regions are the groups."""

    def each(rows: pd.DataFrame, ld: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", ignore_index=True)
        i, j = (np.frombuffer(b"".join(ld[k]), np.int64) for k in ("i", "j"))
        r = np.frombuffer(b"".join(ld["r"]))
        order = np.argsort(i, kind="stable")
        i, j, r = i[order], j[order], r[order]
        place, out = rows["place"].to_numpy(), []
        start = np.flatnonzero(np.diff(rows["region"].to_numpy(), prepend=-1))
        for a, e in zip(start, [*start[1:], len(rows)]):
            s, t = np.searchsorted(i, [place[a], place[e - 1] + 1])
            part = rows.iloc[a:e]
            out.append(work(part, Band(part, i[s:t] - place[a], j[s:t] - place[a], r[s:t], vp)))
        out = [o for o in out if len(o)]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    return markers.groupBy("bag").cogroup(runs.groupBy("bag")).applyInPandas(each, schema)


def selected_rows(rows: pd.DataFrame, band: Band, model: Model) -> pd.DataFrame:
    b, se = model.joint()
    order = np.argsort(model.chosen)
    at, b, se = np.array(model.chosen, int)[order], b[order], se[order]
    return pd.DataFrame({"chr": rows["chr"].to_numpy()[at], "sid": band.sid[at], "b": band.b[at], "se": band.se[at], "bj": b, "bj_se": se, "pj": [chi2_tail(float(x)) for x in (b / se) ** 2]})


JOINT = "chr int, sid long, b double, se double, bj double, bj_se double, pj double"


def cojo(s: DataFrame, pairs: DataFrame, snp: DataFrame, vp: float, most_p: float = 5e-8, top: int | None = None, way: str = "stepwise", most: float = 0.9) -> DataFrame:
    """(chr, sid, b, se, bj, bj_se, pj): markers that selection keeps, with joint effects; see stepwise() for `way`.

    top: at most so many markers of all, those that a selection over all regions at once would take first. Regions are
    independent, so that selection merges their steps by chi-square; a step waits for those before it in its region, hence
    the order by the least chi-square so far, and the merge ends where the models' sizes add up to top."""
    if way not in ("stepwise", "forward", "backward"):
        raise ValueError(f"unknown way {way!r}")
    markers, runs = placed(s, pairs, snp)
    if top is None:
        return by_region(markers, runs, vp, lambda rows, g: selected_rows(rows, g, stepwise(g, most_p, most, way)[0]), JOINT)
    if way == "backward":
        raise ValueError("a bound on the markers goes with entries")

    def steps(rows: pd.DataFrame, g: Band) -> pd.DataFrame:
        _, taken = stepwise(g, most_p, most, way, top)
        return pd.DataFrame({"region": rows["region"].iat[0], "step": np.arange(len(taken)), "chi": np.minimum.accumulate([c for c, _ in taken]) if taken else [], "grew": [k for _, k in taken]})

    order = (F.desc("chi"), F.asc("region"), F.asc("step"))
    sized = ranks.running_sum(by_region(markers, runs, vp, steps, "region long, step long, chi double, grew long"), "grew", *order, name="size")
    sized = keep(ranks.numbered(sized, *order))
    end = sized.where(F.col("size") >= top).agg(F.min("place").alias("end"))
    taken = sized.join(F.broadcast(end)).where("end is null or place <= end").groupBy("region").agg(F.count("*").alias("steps"))  # end is one row

    def again(rows: pd.DataFrame, g: Band) -> pd.DataFrame:
        return selected_rows(rows, g, stepwise(g, most_p, most, way, None, int(rows["steps"].iat[0]))[0])

    return by_region(markers.join(taken, "region"), runs, vp, again, JOINT)


def given_rows(markers: DataFrame, given: list[int] | DataFrame) -> DataFrame:
    if isinstance(given, DataFrame):
        return markers.join(given.select("sid", F.lit(True).alias("given")).distinct(), "sid", "left").fillna(False, ["given"])
    return markers.withColumn("given", F.col("sid").isin(list(given)))


def cojo_joint(s: DataFrame, pairs: DataFrame, snp: DataFrame, vp: float, given: list[int] | DataFrame) -> DataFrame:
    """(chr, sid, b, se, bj, bj_se, pj) of the given markers in one joint model; an error if one is a combination of others."""
    markers, runs = placed(given_rows(s, given).where("given").drop("given"), pairs, snp)

    def work(rows: pd.DataFrame, g: Band) -> pd.DataFrame:
        return selected_rows(rows, g, Model(g).take(range(len(rows))))

    return by_region(markers, runs, vp, work, JOINT)


def cojo_conditional(s: DataFrame, pairs: DataFrame, snp: DataFrame, vp: float, given: list[int] | DataFrame, most: float = 0.9) -> DataFrame:
    """(chr, sid, bc, bc_se, chi2) of all markers given some of their chromosome, without these and those that they nearly
    tell; markers of chromosomes without any are as they are."""
    markers, runs = placed(s, pairs, snp)
    markers = given_rows(markers, given)
    of = F.broadcast(markers.where("given").select("chr", F.lit(True).alias("told")).distinct())  # a row a chromosome
    markers = markers.join(of, "chr", "left").fillna(False, ["told"])

    def work(rows: pd.DataFrame, g: Band) -> pd.DataFrame:
        model = Model(g).take(np.flatnonzero(rows["given"].to_numpy()))
        se = np.sqrt(vp / g.d) if rows["told"].iat[0] else g.se
        left = (model.told < most) & ~rows["given"].to_numpy(bool)
        return pd.DataFrame({"chr": rows["chr"].to_numpy(), "sid": g.sid, "bc": model.bc, "bc_se": se, "chi2": (model.bc / se) ** 2})[left]

    return by_region(markers, runs, vp, work, "chr int, sid long, bc double, bc_se double, chi2 double")


def conjugate_gradients(times: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, diagonal: np.ndarray, most: int, near: float = 1e-13) -> np.ndarray | None:
    """x with times(x) = rhs, preconditioned by the diagonal; None where the product isn't positive or doesn't converge."""
    x, left = np.zeros_like(rhs), rhs.copy()
    z = left / diagonal
    p, rz = z.copy(), float(left @ z)
    for _ in range(most):
        if np.linalg.norm(left) <= near * np.linalg.norm(rhs):
            return x
        q = times(p)
        bend = float(p @ q)
        if bend <= 0:
            return None
        x, left = x + rz / bend * p, left - rz / bend * q
        z = left / diagonal
        rz, before = float(left @ z), rz
        p = z + rz / before * p
    return x if np.linalg.norm(times(x) - rhs) <= 1e-9 * np.linalg.norm(rhs) else None


def sblup(s: DataFrame, pairs: DataFrame, snp: DataFrame, shrink: float) -> DataFrame:
    """(sid, u): solves (R_w N + shrink I) u = sqrt(2pq) N b; R_w is LD inside the window. Conjugate gradients over each
    region; where its products aren't positive (LD cut by a window may be so), over those of the squared equations."""
    markers, runs = placed(s, pairs, snp)

    def work(rows: pd.DataFrame, g: Band) -> pd.DataFrame:
        rhs, diagonal = np.sqrt(g.h) * g.n * g.b, g.n + shrink
        times = lambda x: g.times(x, diagonal)
        u = conjugate_gradients(times, rhs, diagonal, 20 * len(rows) + 100)
        if u is None:
            u = conjugate_gradients(lambda x: times(times(x)), times(rhs), diagonal**2, 200 * len(rows) + 1000)
        if u is None:
            raise ValueError(f"the equations of the region at marker {g.sid[0]} are singular; raise shrink")
        return pd.DataFrame({"sid": g.sid, "u": u})

    return by_region(markers, runs, 1.0, work, "sid long, u double")
