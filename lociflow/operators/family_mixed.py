"""Mixed models over sparse relationships: V = Vg A + Ve I falls into families, which are solved one by one in tasks.

No dense matrix of all individuals is made anywhere: A and the inverse of V are tables (i, j, value) of both triangles
within families. The driver holds vectors of one value an individual.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.functions.stats import chi2_tail
from lociflow.operators.association import interaction_scan, linear_scan, null_markers
from lociflow.operators.linkage import packed

Store = Callable[[DataFrame], DataFrame]


def families(a: DataFrame, store: Store) -> DataFrame:
    """(iid, family): the least iid that relationships of a(i, j, value) reach. Every round takes the least family of all
    relatives and then that family's own, so chains shorten by doubling; rounds are written by `store`."""
    both = a.where("i <> j and value <> 0").select("i", "j")
    edges = store(both.union(both.select("j", "i")).distinct())
    own = store(a.where("i = j").select(F.col("i").alias("iid"), F.col("i").alias("family")))
    while True:
        near = edges.join(own.select(F.col("iid").alias("j"), "family"), "j").groupBy(F.col("i").alias("iid")).agg(F.min("family").alias("near"))
        least = store(own.join(near, "iid", "left").select("iid", F.col("family").alias("before"), F.least("family", "near").alias("family")))
        jump = least.select(F.col("iid").alias("family"), F.col("family").alias("root"))
        new = store(least.join(jump, "family").select("iid", "before", F.col("root").alias("family")))
        own = new.select("iid", "family")
        if not new.where("before <> family").limit(1).count():
            return own


def family_entries(a: DataFrame, y: DataFrame, store: Store) -> DataFrame:
    """(family, members, i, j, value, y) for i >= j of individuals with a phenotype y(iid, y), which is centred and stands
    on the diagonal's rows alone. Relationships may stand in either triangle, but once."""
    known = y.where("y is not null").join(a.where("i = j").select(F.col("i").alias("iid")), "iid", "left_semi")
    known = store(known.join(F.broadcast(known.agg(F.avg("y").alias("mean")))).select("iid", (F.col("y") - F.col("mean")).alias("y")))
    a = a.select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), "value").where("value <> 0 or i = j")
    for side in ("i", "j"):
        a = a.join(known.select(F.col("iid").alias(side)), side, "left_semi")
    a = store(a)
    f = families(a, store)
    size = f.groupBy("family").agg(F.count("*").alias("members"))
    d = a.join(f.select(F.col("iid").alias("i"), "family"), "i").join(size, "family")
    d = d.join(known.select(F.col("iid").alias("i"), "y"), "i")
    return store(d.select("family", "members", "i", "j", "value", F.when(F.col("i") == F.col("j"), F.col("y")).alias("y")))


def _block(rows: pd.DataFrame, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = rows[rows["i"] == rows["j"]].sort_values("i")
    ids = own["i"].to_numpy()
    if len(ids) > largest:
        raise ValueError(f"a family of {len(ids)} individuals is over {largest}: raise the relationships' cutoff")
    m = np.zeros((len(ids), len(ids)))
    i, j = np.searchsorted(ids, rows["i"]), np.searchsorted(ids, rows["j"])
    m[i, j] = m[j, i] = rows["value"]
    return ids, m, own["y"].to_numpy(float)


def rotated(entries: DataFrame, largest: int = 20_000) -> DataFrame:
    """(w, y, one) in the eigenbasis of every family; an individual alone is its own."""
    alone = entries.where("members = 1").select(F.col("value").alias("w"), "y", F.lit(1.0).alias("one"))

    def rotate(rows: pd.DataFrame) -> pd.DataFrame:
        _, m, y = _block(rows, largest)
        w, u = np.linalg.eigh(m)
        return pd.DataFrame({"w": w, "y": u.T @ y, "one": u.sum(axis=0)})

    return alone.unionByName(entries.where("members > 1").groupBy("family").applyInPandas(rotate, "w double, y double, one double"))


@dataclass
class FamilyFit:
    """Components, restricted log likelihood, and Vg's sampling variance by average information."""

    vg: float
    ve: float
    logl: float
    variance: float

    @property
    def p(self) -> float:
        return chi2_tail(self.vg * self.vg / self.variance) if self.variance > 0 else 1.0


def fit(entries: DataFrame, store: Store, most_share: float = 1.6, grid: int = 101, refine: int = 12, largest: int = 20_000) -> FamilyFit:
    """Vg and Ve = Vp - Vg of the highest restricted likelihood on a grid of Vg from 0 to most_share Vp, refined between
    the best point's neighbours. Sums of a round's points combine in tasks; the driver gets one row a point."""
    rows = store(rotated(entries, largest))
    n, yy = entries.where("i = j").agg(F.count("*"), F.sum(F.col("y") * F.col("y"))).first()
    if n < 2 or not yy:
        raise ValueError("the phenotype does not vary")
    vp = yy / (n - 1)

    def values(points: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(points), 5))
            for b in batches:
                for s in range(0, len(b), 4096):
                    w, y, one = (b[c].to_numpy()[s : s + 4096] for c in ("w", "y", "one"))
                    v = points[:, None] * w + (vp - points)[:, None]
                    ok = v > 0
                    v = np.where(ok, v, 1.0)
                    total += np.stack([(~ok).sum(1), np.log(v).sum(1), (one * one / v).sum(1), (one * y / v).sum(1), (y * y / v).sum(1)], axis=1)
            yield pd.DataFrame({"k": np.arange(len(points)), **{c: total[:, i] for i, c in enumerate(("bad", "logdet", "xx", "xy", "yy"))}})

        s = rows.mapInPandas(partial, "k int, bad double, logdet double, xx double, xy double, yy double")
        s = s.groupBy("k").agg(*(F.sum(c).alias(c) for c in ("bad", "logdet", "xx", "xy", "yy"))).orderBy("k").toPandas()
        with np.errstate(divide="ignore", invalid="ignore"):
            logl = -0.5 * (s.logdet + np.log(s.xx) + s.yy - s.xy * s.xy / s.xx)
        return np.where(s.bad > 0, -np.inf, logl)

    points = np.linspace(0.0, most_share * vp, grid)
    logl = values(points)
    for _ in range(refine):
        k = int(np.argmax(logl))
        points = np.linspace(points[max(k - 1, 0)], points[min(k + 1, len(points) - 1)], 16)
        logl = values(points)
    k = int(np.argmax(logl))
    vg, ve = float(points[k]), float(vp - points[k])
    return FamilyFit(vg, ve, float(logl[k]), _sampling_variance(rows, vg, ve))


def _sampling_variance(rows: DataFrame, vg: float, ve: float) -> float:
    """Of Vg: the average information holds y'P A P A P y and its like, which are sums over the eigenbasis."""
    d = rows.withColumn("v", F.col("w") * vg + ve)
    xx, xy = d.agg(F.sum(F.col("one") * F.col("one") / F.col("v")), F.sum(F.col("one") * F.col("y") / F.col("v"))).first()
    d = d.withColumn("py", (F.col("y") - F.col("one") * (xy / xx)) / F.col("v"))
    q, t = F.col("py") * F.col("py") / F.col("v"), F.col("one") * F.col("py") / F.col("v")
    a, b, c, at, bt = d.agg(F.sum(F.col("w") * F.col("w") * q), F.sum(F.col("w") * q), F.sum(q), F.sum(F.col("w") * t), F.sum(t)).first()
    info = 0.5 * np.array([[a - at * at / xx, b - at * bt / xx], [b - at * bt / xx, c - bt * bt / xx]])
    return float(np.linalg.pinv(info)[0, 0])


def null_model(found: FamilyFit, force: bool = False, constrain: bool = True) -> FamilyFit | None:
    """What a scan goes on with: None, for the linear scan, when Vg isn't significant (p over 0.05) or is below zero,
    unless forced; else Vg, held to 0.99 Vp when it is over Vp."""
    if not force and (found.p > 0.05 or found.vg < 0):
        return None
    vp = found.vg + found.ve
    if found.vg > vp and constrain:
        return FamilyFit(0.99 * vp, 0.01 * vp, found.logl, found.variance)
    return found


def inverse(entries: DataFrame, vg: float, ve: float, largest: int = 20_000) -> DataFrame:
    """(family, i, j, value, vy) for i >= j of the inverse of V; vy is the inverse times y, on the diagonal's rows."""
    v = F.lit(vg) * F.col("value") + F.lit(ve)
    alone = entries.where("members = 1").select("family", "i", "j", (1 / v).alias("value"), (F.col("y") / v).alias("vy"))

    def invert(rows: pd.DataFrame) -> pd.DataFrame:
        ids, m, y = _block(rows, largest)
        vi = np.linalg.inv(vg * m + ve * np.eye(len(ids)))
        vy = vi @ y
        i, j = np.tril_indices(len(ids))
        return pd.DataFrame({"family": rows["family"].iloc[0], "i": ids[i], "j": ids[j], "value": vi[i, j], "vy": np.where(i == j, vy[i], np.nan)})

    together = entries.where("members > 1").groupBy("family").applyInPandas(invert, "family long, i long, j long, value double, vy double")
    return alone.unionByName(together.withColumn("vy", F.when(F.col("i") == F.col("j"), F.col("vy"))))


SUMS = "sid long, xvx double, xvy double, xx double"


def scan_sums(g: DataFrame, vi: DataFrame, store: Store, exact: bool = True, most_entries: int = 2**23) -> DataFrame:
    """(sid, xvx, xvy, xx) of every marker, x its calls centred, missing at 0.

    The inverse is broadcast in pieces of whole families of about most_entries entries (24 bytes each); x'Vi x adds up
    over pieces, as no entry joins two families. Without `exact` xvx is null and only vectors are broadcast."""
    spark = g.sparkSession
    own = vi.where("i = j").select("i", "vy").orderBy("i").toPandas()
    ids, vy = own["i"].to_numpy(), own["vy"].to_numpy(float)
    kept = g.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"iid": ids}))), "iid")
    markers = packed(kept, ids=ids)
    pieces = max(1, -(-vi.count() // most_entries)) if exact else 1
    if pieces > 1:
        markers = store(markers)
    out = None
    for piece in range(pieces):
        entries = None
        if exact:
            part = vi.where(F.pmod(F.xxhash64("family"), F.lit(pieces)) == piece).select("i", "j", "value").toPandas()
            part["value"] *= np.where(part["i"] == part["j"], 1.0, 2.0)
            entries = (np.searchsorted(ids, part["i"]), np.searchsorted(ids, part["j"]), part["value"].to_numpy())
        known = spark.sparkContext.broadcast((vy, entries))

        def run(batches: Iterator[pd.DataFrame], known=known, first=piece == 0) -> Iterator[pd.DataFrame]:
            vy, entries = known.value
            for b in batches:
                for s in range(0, len(b), 256):
                    rows = b.iloc[s : s + 256]
                    x = np.stack(list(rows["x"]))
                    called = ~np.isnan(x)
                    mean = np.divide(np.nansum(x, axis=1), called.sum(axis=1), out=np.zeros(len(x)), where=called.any(axis=1))
                    x = np.where(called, x - mean[:, None], 0.0)
                    xvx = np.full(len(x), np.nan)
                    if entries is not None:
                        i, j, v = entries
                        xvx = sum(((x[:, i[k : k + 16384]] * x[:, j[k : k + 16384]]) @ v[k : k + 16384] for k in range(0, len(v), 16384)), np.zeros(len(x)))
                    yield pd.DataFrame({"sid": rows["sid"].to_numpy(), "xvx": xvx, "xvy": x @ vy if first else 0.0, "xx": (x * x).sum(1) if first else 0.0})

        d = markers.mapInPandas(run, SUMS)
        if pieces > 1:
            d = store(d)
            known.destroy()
        out = d if out is None else out.unionByName(d)
    return out if pieces == 1 else out.groupBy("sid").agg(*(F.sum(c).alias(c) for c in ("xvx", "xvy", "xx")))


def _tests(sums: DataFrame, squares: F.Column) -> DataFrame:
    b = F.col("xvy") / F.col("q")
    d = sums.withColumn("q", squares).where("q > 1e-12").select("sid", b.alias("b"), (1 / F.sqrt("q")).alias("se"), (b * F.col("xvy")).alias("chi2"))

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield t.assign(p=[chi2_tail(float(v)) for v in t["chi2"]])

    return d.mapInPandas(tails, "sid long, b double, se double, chi2 double, p double")


def scan_exact(g: DataFrame, vi: DataFrame, store: Store, most_entries: int = 2**23) -> DataFrame:
    """b = x'Vi y / x'Vi x and se = (x'Vi x)^-1/2 of every marker; markers that do not vary give no row."""
    return _tests(scan_sums(g, vi, store, True, most_entries), F.col("xvx"))


def gamma(g: DataFrame, vi: DataFrame, store: Store, count: int = 2000, seed: int = 1, most_chi2: float = 5.0) -> float:
    """Mean of x'Vi x / x'x over null markers (by hash) whose exact chi-square stays under most_chi2."""
    few = g.join(F.broadcast(null_markers(g, count, seed)), "sid", "left_semi")
    s = scan_sums(few, vi, store).where("xvx > 1e-12")
    found = s.where(F.col("xvy") * F.col("xvy") / F.col("xvx") < most_chi2).agg(F.avg(F.col("xvx") / F.col("xx"))).first()[0]
    if found is None:
        raise ValueError("no null marker varies")
    return float(found)


def scan_approximate(g: DataFrame, vi: DataFrame, ratio: float, store: Store) -> DataFrame:
    """As scan_exact with x'x times gamma's ratio in place of x'Vi x."""
    return _tests(scan_sums(g, vi, store, False), F.col("xx") * F.lit(ratio))


def family_scan(g: DataFrame, a: DataFrame, y: DataFrame, store: Store, force: bool = False, constrain: bool = True, approximate: bool = False) -> DataFrame:
    """(sid, b, se, chi2) of every marker from relationships a(i, j, value) and phenotypes y(iid, y): fit, null_model(),
    then the exact or approximate scan, or the linear one where Vg isn't significant."""
    entries = family_entries(a, y, store)
    model = null_model(fit(entries, store), force, constrain)
    if model is None:
        own = entries.where("i = j").select(F.col("i").alias("iid"), "y")
        return linear_scan(g, own).select("sid", "b", "se", "chi2")
    vi = store(inverse(entries, model.vg, model.ve))
    d = scan_approximate(g, vi, gamma(g, vi, store), store) if approximate else scan_exact(g, vi, store)
    return d.select("sid", "b", "se", "chi2")


def monte_carlo(g: DataFrame, entries: DataFrame, store: Store, seed: int = 1, rounds: int = 5, largest: int = 20_000) -> float:
    """Vg by Monte-Carlo REML: the ratio of marker effects' to residuals' squares, in the data against phenotypes drawn
    under the model, is driven to one over log(Ve / Vg) by secant steps.

    Draws are seeded by sid and iid, so reruns agree; 3 to 15 of them, fewer for more individuals. g holds all calls of
    the individuals of entries. A task returns its part of the drawn phenotypes once; the driver holds one value an
    individual and draw.
    """
    spark = g.sparkSession
    own = entries.where("i = j").select("i", "y").orderBy("i").toPandas()
    ids, y = own["i"].to_numpy(), own["y"].to_numpy(float)
    n, trials = len(ids), int(min(15, max(3, 4e9 // len(ids))))
    kept = g.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"iid": ids}))), "iid")
    markers = store(packed(kept, ids=ids).select("sid", "x"))
    m = markers.count()

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            for s in range(0, len(b), 512):
                x = np.stack(list(b["x"].iloc[s : s + 512]))
                called = ~np.isnan(x)
                mean = np.divide(np.nansum(x, axis=1), called.sum(axis=1), out=np.zeros(len(x)), where=called.any(axis=1))
                scale = np.sqrt(mean * (1 - mean / 2))
                z = np.where(called, x - mean[:, None], 0.0)
                yield b["sid"].to_numpy()[s : s + 512], np.divide(z, scale[:, None], out=np.zeros_like(z), where=scale[:, None] > 1e-12)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, trials))
        for sids, z in blocks(batches):
            total += z.T @ np.array([np.random.default_rng([seed, int(s)]).normal(size=trials) for s in sids]) / np.sqrt(m)
        yield pd.DataFrame(total, columns=names).assign(place=np.arange(n))

    names = [f"t{k}" for k in range(trials)]
    parts = markers.coalesce(64).mapInPandas(drawn, ", ".join(f"{c} double" for c in names) + ", place int")
    genetic = parts.groupBy("place").agg(*(F.sum(c).alias(c) for c in names)).orderBy("place").toPandas()[names].to_numpy()
    noise = np.array([np.random.default_rng([seed, int(i), 1]).normal(size=trials) for i in ids])

    def solve(columns: np.ndarray, ratio: float) -> np.ndarray:
        """(A + ratio I)^-1 times columns, family by family."""
        schema = "i long, v array<double>"
        d = entries.join(spark.createDataFrame(pd.DataFrame({"i": ids, "v": columns.tolist()}), schema), "i")
        alone = d.where("members = 1").select("i", F.transform("v", lambda e: e / (F.col("value") + ratio)).alias("v"))

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            found, a, _ = _block(rows, largest)
            v = np.stack(list(rows[rows["i"] == rows["j"]].sort_values("i")["v"]))
            return pd.DataFrame({"i": found, "v": list(np.linalg.solve(a + ratio * np.eye(len(found)), v))})

        done = alone.unionByName(d.where("members > 1").groupBy("family").applyInPandas(one, schema)).orderBy("i").toPandas()
        return np.stack(list(done["v"]))

    def departure(log_ratio: float) -> tuple[float, float]:
        ratio = float(np.exp(log_ratio))
        u = solve(np.column_stack([y, genetic + np.sqrt(ratio) * noise]), ratio)
        known = spark.sparkContext.broadcast(u)

        def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(trials + 1)
            for _, z in blocks(batches):
                total += ((z @ known.value) ** 2).sum(axis=0)
            yield pd.DataFrame({"k": np.arange(trials + 1), "b": total})

        b = markers.mapInPandas(squares, "k int, b double").groupBy("k").agg(F.sum("b").alias("b")).orderBy("k").toPandas()["b"].to_numpy()
        known.destroy()
        e = (u * u).sum(axis=0)
        return float(np.log((b[0] / e[0]) / (b[1:].sum() / e[1:].sum()))), float(y @ u[:, 0] / n)

    before = float(np.log(3.0))  # Vg a quarter of all
    f_before, _ = departure(before)
    at = float(np.log(7.0)) if f_before < 0 else 0.0
    f_at, vg = departure(at)
    for _ in range(rounds):
        if f_at == f_before:
            break
        new = (before * f_at - at * f_before) / (f_at - f_before)
        if abs(new - at) < 0.01:
            break
        before, f_before, at = at, f_at, new
        f_at, vg = departure(at)
    return vg


@dataclass
class InteractionFit:
    """Share rho of the relationships against those scaled by the environment, components, and log likelihood."""

    rho: float
    vg: float
    ve: float
    logl: float


def interaction_entries(entries: DataFrame, env: DataFrame, rhos: np.ndarray) -> DataFrame:
    """entries with rho and value = rho a + (1 - rho) e_i a e_j for each rho, y without its regression on e. env(iid, e) is
    standardised over the individuals of entries; those without e are left out."""
    own = entries.where("i = j").select(F.col("i").alias("iid"), "y").join(env.where("e is not null"), "iid")
    s = own.agg(F.avg("e").alias("me"), F.stddev_samp("e").alias("se"), F.regr_slope("y", "e").alias("b"), F.avg("y").alias("my"))
    known = own.join(F.broadcast(s)).select("iid", ((F.col("e") - F.col("me")) / F.col("se")).alias("e"), (F.col("y") - F.col("my") - F.col("b") * (F.col("e") - F.col("me"))).alias("left"))
    d = entries.join(known.select(F.col("iid").alias("i"), F.col("e").alias("ei"), "left"), "i").join(known.select(F.col("iid").alias("j"), F.col("e").alias("ej")), "j")
    d = d.withColumn("rho", F.explode(F.array(*[F.lit(float(r)) for r in rhos])))
    value = F.col("value") * (F.col("rho") + (1 - F.col("rho")) * F.col("ei") * F.col("ej"))
    return d.select("rho", "family", "members", "i", "j", value.alias("value"), F.when(F.col("i") == F.col("j"), F.col("left")).alias("y"))


def fit_interaction(entries: DataFrame, env: DataFrame, store: Store, rhos: np.ndarray = np.linspace(0, 1, 11), most_share: float = 1.6, grid: int = 41, refine: int = 7, largest: int = 20_000) -> tuple[InteractionFit, DataFrame]:
    """The rho and Vg, with Ve = Vp - Vg, of the highest restricted likelihood of V = Vg (rho A + (1 - rho) E A E) + Ve I,
    and the entries of that rho.

    Families are rotated once for every rho; then each round takes one pass for the points of all rhos, which are refined
    between the neighbours of their own best one."""
    every = store(interaction_entries(entries, env, rhos))

    def rotate(rows: pd.DataFrame) -> pd.DataFrame:
        _, m, y = _block(rows, largest)
        w, u = np.linalg.eigh(m)
        return pd.DataFrame({"rho": rows["rho"].iloc[0], "w": w, "y": u.T @ y, "one": u.sum(axis=0)})

    alone = every.where("members = 1").select("rho", F.col("value").alias("w"), "y", F.lit(1.0).alias("one"))
    rows = store(alone.unionByName(every.where("members > 1").groupBy("rho", "family").applyInPandas(rotate, "rho double, w double, y double, one double")))
    first = every.where((F.col("rho") == float(rhos[0])) & (F.col("i") == F.col("j")))
    n, yy = first.agg(F.count("*"), F.sum(F.col("y") * F.col("y"))).first()
    if n < 3 or not yy:
        raise ValueError("the phenotype does not vary beside the environment")
    vp = yy / (n - 2)
    names = ("bad", "logdet", "xx", "xy", "yy")

    def values(points: dict[float, np.ndarray]) -> dict[float, np.ndarray]:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {r: np.zeros((len(p), 5)) for r, p in points.items()}
            for b in batches:
                for rho, d in b.groupby("rho"):
                    at = points[rho]
                    for s in range(0, len(d), 4096):
                        w, y, one = (d[c].to_numpy()[s : s + 4096] for c in ("w", "y", "one"))
                        v = at[:, None] * w + (vp - at)[:, None]
                        ok = v > 0
                        v = np.where(ok, v, 1.0)
                        total[rho] += np.stack([(~ok).sum(1), np.log(v).sum(1), (one * one / v).sum(1), (one * y / v).sum(1), (y * y / v).sum(1)], axis=1)
            for rho, t in total.items():
                yield pd.DataFrame({"rho": rho, "k": np.arange(len(t)), **{c: t[:, i] for i, c in enumerate(names)}})

        s = rows.mapInPandas(partial, "rho double, k int, " + ", ".join(f"{c} double" for c in names))
        s = s.groupBy("rho", "k").agg(*(F.sum(c).alias(c) for c in names)).toPandas()  # a row a point
        out = {}
        for rho, t in s.groupby("rho"):
            t = t.sort_values("k")
            with np.errstate(divide="ignore", invalid="ignore"):
                logl = -0.5 * (t.logdet + np.log(t.xx) + t.yy - t.xy * t.xy / t.xx)
            out[float(rho)] = np.where(t.bad > 0, -np.inf, logl)
        return out

    points = {float(r): np.linspace(0.0, most_share * vp, grid) for r in rhos}
    logl = values(points)
    for _ in range(refine):
        for r, p in points.items():
            k = int(np.argmax(logl[r]))
            points[r] = np.linspace(p[max(k - 1, 0)], p[min(k + 1, len(p) - 1)], 11)
        logl = values(points)
    best = max(points, key=lambda r: logl[r].max())
    k = int(np.argmax(logl[best]))
    found = InteractionFit(best, float(points[best][k]), float(vp - points[best][k]), float(logl[best][k]))
    return found, every.where(F.col("rho") == best).drop("rho")


def interaction_family_scan(g: DataFrame, entries: DataFrame, env: DataFrame, store: Store, robust: bool = True, rhos: np.ndarray = np.linspace(0, 1, 11)) -> tuple[InteractionFit, DataFrame]:
    """The fit, and the interaction scan of Ve V^-1 y, y without its polygenic part, family by family; where Vg or Ve is
    nothing, of y itself."""
    found, chosen = fit_interaction(entries, env, store, rhos)
    own = chosen.where("i = j").select(F.col("i").alias("iid"), "y")
    if found.vg > 0 and found.ve > 1e-6 * (found.vg + found.ve):
        own = inverse(chosen, found.vg, found.ve).where("i = j").select(F.col("i").alias("iid"), (F.col("vy") * found.ve).alias("y"))
    return found, interaction_scan(g, store(own), env, robust)
