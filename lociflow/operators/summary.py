"""Analyses of association summary tables sumstat(snp, a1, a2, freq, b, se, p, n), with trait where there are several."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.functions.stats import cauchy_combine, chi2_mixture_tail, chi2_tail
from lociflow.operators import heidi as hd
from lociflow.operators.linkage import clump, window_pairs


def genomic_inflation(s: DataFrame) -> DataFrame:
    z = F.col("b") / F.col("se")
    return s.agg((F.median(z * z) / 0.455).alias("lambda_gc"))


def phenotypic_variance(s: DataFrame) -> DataFrame:
    """Median of 2pq N se^2 + 2pq b^2 N / (N - 1)."""
    h = 2 * F.col("freq") * (1 - F.col("freq"))
    n = F.col("n")
    return s.agg(F.median(h * n * F.col("se") * F.col("se") + h * F.col("b") * F.col("b") * n / (n - 1)).alias("vp"))


def effective_n(s: DataFrame) -> DataFrame:
    h = 2 * F.col("freq") * (1 - F.col("freq"))
    vp = F.broadcast(phenotypic_variance(s))
    return s.join(vp).select("snp", ((F.col("vp") - h * F.col("b") * F.col("b")) / (h * F.col("se") * F.col("se")) + 1).alias("n_eff"))


def overlap_correlation(s: DataFrame, one: str, two: str, least_p: float = 0.01) -> DataFrame:
    """Correlation of two traits' z over the markers with p >= least_p in both."""
    pick = lambda t, k: s.where((F.col("trait") == t) & (F.col("p") >= least_p)).select("snp", (F.col("b") / F.col("se")).alias(k))
    return pick(one, "z1").join(pick(two, "z2"), "snp").agg(F.corr("z1", "z2").alias("r"), F.count("*").alias("n"))


def significant(s: DataFrame, most_p: float) -> DataFrame:
    """Markers with p under the bound in any trait."""
    return s.groupBy("snp").agg(F.bool_or(F.col("p") < most_p).alias("any")).where("any").select("snp")


def aligned_traits(s: DataFrame) -> DataFrame:
    """snp with the number of traits that have a usable row, for all that any has."""
    return s.groupBy("snp").agg(F.count_distinct(F.when(F.col("se") > 0, F.col("trait"))).alias("traits"))


def members(snp: DataFrame, genes: DataFrame, window: int = 50_000, width: int = 100_000) -> DataFrame:
    """(gene, sid, bp) of the markers from window before a gene's start to window behind its end. Genes are put into all
    bins of `width` bp that they cover, so the range join is an equi-join on chromosome and bin."""
    g = genes.select(F.col("name").alias("gene"), "chr", (F.col("start") - window).alias("lo"), (F.col("end") + window).alias("hi"))
    g = g.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    m = snp.withColumn("bin", F.floor(F.col("bp") / width))
    return m.join(g, ["chr", "bin"]).where("bp >= lo and bp <= hi").select("gene", "sid", "bp")


def gene_sums(stats: DataFrame, genes: DataFrame) -> DataFrame:
    """gene, n_snps, chi2 (sum), top_sid and top_chi2; genes: (gene, sid), stats: (sid, chi2)."""
    j = genes.join(stats.select("sid", "chi2"), "sid")
    top = F.max(F.struct("chi2", (-F.col("sid")).alias("minus")))
    return j.groupBy("gene").agg(F.count("*").alias("n_snps"), F.sum("chi2").alias("chi2"), top.alias("t")).select("gene", "n_snps", "chi2", (-F.col("t.minus")).alias("top_sid"), F.col("t.chi2").alias("top_chi2"))


def gene_tests(stats: DataFrame, genes: DataFrame, ld: DataFrame, most_r2: float = 0.9, share: float = 0.9, most_snps: int = 10_000) -> DataFrame:
    """gene, n_snps, chi2, p_sum, p_mbat and p_combined. ld holds (gene, sid1, sid2, r), all pairs of a gene's markers.

    Markers are pruned at most_r2 first. p_sum: the sum of chi-squares against the mixture by the eigenvalues of their
    correlations. p_mbat: z'U diag(1/lambda) U'z over the leading eigenvalues that hold `share` of the sum; both are joined
    by Cauchy weights. stats: (sid, z). A gene over most_snps isn't pruned and takes no dense matrix: its p_sum matches
    the mixture's mean and variance, which the pairs give (the sum of eigenvalues is the number of markers, that of their
    squares the sum of r2), and p_combined is p_sum."""
    own = genes.join(stats.select("sid", "z"), "sid").groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("sid", "z"))).alias("zs"))
    pairs = ld.groupBy("gene").agg(F.collect_list(F.struct("sid1", "sid2", "r")).alias("ld"))

    def test(batches):
        for batch in batches:
            rows = []
            for gene, zs, near in zip(batch["gene"], batch["zs"], batch["ld"]):
                sid = np.array([v["sid"] for v in zs])
                z = np.array([v["z"] for v in zs], float)
                m = len(sid)
                chi = float((z * z).sum())
                if m > most_snps:
                    scale = (m + 2 * sum(v["r"] ** 2 for v in near if v["sid1"] < v["sid2"])) / m if near is not None else 1.0
                    p_sum = chi2_tail(chi / scale, m / scale)
                    rows.append((gene, m, chi, p_sum, np.nan, p_sum))
                    continue
                r = np.eye(m)
                for v in near if near is not None else ():
                    i, j = np.searchsorted(sid, (v["sid1"], v["sid2"]))
                    r[i, j] = r[j, i] = v["r"]
                over = np.tril(r * r > most_r2, -1)
                degree = (over | over.T).sum(axis=1)
                gone = {int(i if degree[i] >= degree[j] else j) for i, j in zip(*np.nonzero(over))}
                keep = np.array([i not in gone for i in range(m)])
                w, u = np.linalg.eigh(r[np.ix_(keep, keep)])
                p_sum = chi2_mixture_tail(float((z[keep] ** 2).sum()), w)
                order = np.argsort(-w)
                w, u = w[order], u[:, order]
                k = min(int(np.searchsorted(np.cumsum(w) / w.sum(), share) + 1), int((w > 1e-8).sum()))
                q = float((((u[:, :k].T @ z[keep]) ** 2) / w[:k]).sum())
                p_mbat = chi2_tail(q, k)
                t = np.mean([np.tan((0.5 - p) * np.pi) if p > 1e-15 else 1 / (max(p, 1e-300) * np.pi) for p in (p_sum, p_mbat)])
                combined = 1 / (t * np.pi) if t > 1e15 else 0.5 - np.arctan(t) / np.pi
                rows.append((gene, int(keep.sum()), chi, p_sum, p_mbat, combined))
            yield pd.DataFrame(rows, columns=["gene", "n_snps", "chi2", "p_sum", "p_mbat", "p_combined"])

    return own.join(pairs, "gene", "left").mapInPandas(test, "gene string, n_snps long, chi2 double, p_sum double, p_mbat double, p_combined double")


def acat_v(s: DataFrame, genes: DataFrame, most_maf: float = 0.01, least_mac: int = 20) -> DataFrame:
    """gene, n_snps and p: rare markers' p-values joined by Cauchy weights (25 (1 - x)^24 * pi sqrt(x (1 - x)))^2, x the
    minor frequency. s: (sid, freq, n, p); genes: (gene, sid)."""
    maf = F.least("freq", 1 - F.col("freq"))
    rare = s.withColumn("maf", maf).where((F.col("maf") <= most_maf) & (F.floor(2 * F.col("n") * F.col("maf")) >= least_mac) & (F.col("maf") > 0))
    w = F.pow(25 * F.pow(1 - F.col("maf"), 24) * F.pi() * F.sqrt(F.col("maf") * (1 - F.col("maf"))), 2)
    return genes.join(rare, "sid").groupBy("gene").agg(F.count("*").alias("n_snps"), cauchy_combine(F.col("p"), w).alias("p"))


@dataclass
class Ldsc:
    intercept: float
    value: float


def _round(df: DataFrame, x: str, y: str, w: str, with_intercept: bool) -> tuple[float, float]:
    """Slope and intercept of a weighted regression, from one aggregate of sums; weights enter by their square roots over
    the sum of those."""
    ww = F.col(w)
    r = df.agg(*[F.sum(e).alias(k) for k, e in {"s1": ww, "sx": ww * F.col(x), "sy": ww * F.col(y), "sxx": ww * F.col(x) * F.col(x), "sxy": ww * F.col(x) * F.col(y)}.items()]).first()
    if not with_intercept:
        return r.sxy / r.sxx, 0.0
    slope = (r.s1 * r.sxy - r.sx * r.sy) / (r.s1 * r.sxx - r.sx * r.sx)
    return slope, (r.sy - slope * r.sx) / r.s1


def _h2_weight(intercept: float, h: float, m: int, ld: str, n: str = "n") -> F.Column:
    h = min(max(h, 0.0), 1.0)
    d = F.lit(intercept) + F.lit(h / m) * F.col(n) * F.greatest(F.col(ld), F.lit(1.0))
    return 1 / (2 * F.greatest(F.col("w_ld"), F.lit(1.0)) * d * d)


def ldsc_h2(s: DataFrame, m: int, two_steps: bool = True, threshold: float = 30.0) -> Ldsc:
    """Heritability by regression of chi2 on LD scores s(chi2, n, ld, w_ld), m markers: weights from a prior, then three
    rounds. Two steps: the intercept from markers under the threshold, then the slope from all with it fixed."""
    r = s.agg(F.avg("chi2").alias("c"), F.avg(F.col("ld") * F.col("n")).alias("d"), F.avg("n").alias("n")).first()
    mean_n, prior = r.n, (r.c - 1) * m / r.d
    s = s.withColumn("x", F.col("ld") * F.col("n") / mean_n)
    intercept, h = 1.0, prior
    if not two_steps:
        for _ in range(3):
            b, a = _round(s.withColumn("w", _h2_weight(intercept, h, m, "ld")), "x", "chi2", "w", True)
            intercept, h = a, b * m / mean_n
        return Ldsc(intercept, h)
    few = s.where(F.col("chi2") < threshold)
    few_n = few.agg(F.avg("n")).first()[0]
    column = "ld"
    for _ in range(3):
        b, a = _round(few.withColumn("w", _h2_weight(intercept, h, m, column)), "x", "chi2", "w", True)
        intercept, h, column = a, b * m / few_n, "x"
    fixed = s.withColumn("y", F.col("chi2") - intercept)
    weight_i, weight_h = 1.0, prior
    for _ in range(3):
        b, _a = _round(fixed.withColumn("w", _h2_weight(weight_i, weight_h, m, "ld")), "x", "y", "w", False)
        h = b * m / mean_n
        weight_i, weight_h = intercept, h
    return Ldsc(intercept, h)


def ldsc_rg(s: DataFrame, m: int, one: Ldsc, two: Ldsc) -> Ldsc:
    """Genetic correlation from s(z1, z2, n1, n2, ld, w_ld): three rounds of weighted regression of z1 z2."""
    s = s.withColumn("zz", F.col("z1") * F.col("z2")).withColumn("n", F.sqrt(F.col("n1") * F.col("n2")))
    r = s.agg(F.avg("zz").alias("c"), F.avg(F.col("ld") * F.col("n")).alias("d"), F.avg("n").alias("n")).first()
    s = s.withColumn("x", F.col("ld") * F.col("n") / r.n)
    intercept, g = 0.0, r.c * m / r.d
    bound = lambda v: min(max(v, 0.0), 1.0)
    for _ in range(3):
        ld = F.greatest(F.col("ld"), F.lit(1.0))
        d1 = F.col("n1") * bound(one.value) * ld / m + one.intercept
        d2 = F.col("n2") * bound(two.value) * ld / m + two.intercept
        d3 = F.col("n") * min(max(g, -1.0), 1.0) * ld / m + intercept
        b, intercept = _round(s.withColumn("w", 1 / (F.greatest(F.col("w_ld"), F.lit(1.0)) * (d1 * d2 + d3 * d3))), "x", "zz", "w", True)
        g = b * m / r.n
    return Ldsc(intercept, g / np.sqrt(one.value * two.value) if one.value > 0 and two.value > 0 else np.nan)


def condition_on_trait(s: DataFrame, outcome: str, exposure: str, bxy: float, intercept: float) -> DataFrame:
    """Effects of outcome given exposure: b - bxy bzx, with errors for the overlap intercept."""
    pick = lambda t, k: s.where(F.col("trait") == t).select("snp", F.col("b").alias(f"b{k}"), F.col("se").alias(f"se{k}"))
    j = pick(outcome, "y").join(pick(exposure, "x"), "snp")
    b = F.col("by") - bxy * F.col("bx")
    v = F.col("sey") * F.col("sey") + bxy * bxy * F.col("sex") * F.col("sex") - 2 * bxy * intercept * F.col("sex") * F.col("sey")
    return j.select("snp", b.alias("bc"), F.sqrt(v).alias("bc_se"), (b * b / v).alias("chi2"))


def condition_on_traits(s: DataFrame, outcome: str, exposures: list[str], bxy: np.ndarray, rg: np.ndarray, vg: np.ndarray, intercepts: np.ndarray) -> DataFrame:
    """The same for several exposures: joint effects D^-1 R^-1 D bxy with D the roots of genetic variances and R the
    genetic correlations; intercepts[0, k]: overlap of the outcome with exposure k, [j, k]: of exposures."""
    d = np.sqrt(vg)
    joint = np.linalg.solve(np.diag(d), np.linalg.solve(rg, d * bxy))
    j = s.where(F.col("trait") == outcome).select("snp", F.col("b").alias("by"), F.col("se").alias("sey"))
    for k, t in enumerate(exposures):
        j = j.join(s.where(F.col("trait") == t).select("snp", F.col("b").alias(f"b{k}"), F.col("se").alias(f"se{k}")), "snp")
    b, v = F.col("by"), F.col("sey") * F.col("sey")
    for k in range(len(exposures)):
        b = b - float(joint[k]) * F.col(f"b{k}")
        v = v - 2 * float(joint[k] * intercepts[0, k + 1]) * F.col(f"se{k}") * F.col("sey")
        for i in range(len(exposures)):
            v = v + float(joint[k] * joint[i] * (1.0 if i == k else intercepts[i + 1, k + 1])) * F.col(f"se{k}") * F.col(f"se{i}")
    return j.select("snp", b.alias("bc"), F.sqrt(v).alias("bc_se"), (b * b / v).alias("chi2"))


@dataclass
class Conditioning:
    """What mtcojo() estimates: single and joint effects of the exposures, their heritabilities and correlations, and
    intercepts of all traits, the outcome first."""

    bxy: np.ndarray
    joint: np.ndarray
    h2: np.ndarray
    rg: np.ndarray
    intercepts: np.ndarray


def mtcojo(s: DataFrame, g: DataFrame, snp: DataFrame, scores: DataFrame, outcome: str, exposures: list[str], store, m: int, two_steps: bool = True, least_chi2: float = 29.7168, least: int = 10, heidi_p: float = 0.01, heidi: str = "iterated") -> tuple[DataFrame, Conditioning]:
    """(condition_on_traits() of the outcome, the estimates that it took): effects of each exposure by GSMR over its
    instruments, heritabilities, correlations and sample overlap by LD-score regression.

    s: (sid, snp, trait, b, se, chi2, n), alleles aligned; scores: (sid, ld, w_ld) of m markers. Rows without b or
    with an error that isn't positive take no part. An error where an exposure has fewer than `least` instruments or no
    heritability, or where two have no correlation within one."""
    s = store(s.where("b is not null and se > 0"))
    found = {r.exposure: r.bxy for r in gsmr_traits(s, g, snp, exposures, [outcome], store, "forward", least_chi2, least, heidi_p=heidi_p, heidi=heidi)[0].collect()}  # a row an exposure
    traits = [outcome, *exposures]
    rows = {t: store(s.where(F.col("trait") == t).select("sid", "chi2", (F.col("b") / F.col("se")).alias("z"), "n").join(scores, "sid")) for t in traits}
    fits = {t: ldsc_h2(rows[t], m, two_steps) for t in traits}
    for t in exposures:
        if found[t] is None:
            raise ValueError(f"fewer than {least} instruments of {t}")
        if not fits[t].value > 0:
            raise ValueError(f"no heritability of {t}: {fits[t].value}")
    rg, intercepts = np.eye(len(traits)), np.diag([fits[t].intercept for t in traits])
    for i, one in enumerate(traits):
        for j, two in enumerate(traits[:i]):
            pair = rows[one].select("sid", F.col("z").alias("z1"), F.col("n").alias("n1"), "ld", "w_ld").join(rows[two].select("sid", F.col("z").alias("z2"), F.col("n").alias("n2")), "sid")
            fit = ldsc_rg(pair, m, fits[one], fits[two])
            rg[i, j] = rg[j, i] = fit.value
            intercepts[i, j] = intercepts[j, i] = fit.intercept
            if j and not abs(fit.value) < 1:
                raise ValueError(f"no correlation of {one} and {two} within one: {fit.value}")
    bxy, h2 = np.array([found[t] for t in exposures]), np.array([fits[t].value for t in exposures])
    d = np.sqrt(h2)
    joint = np.linalg.solve(rg[1:, 1:], d * bxy) / d
    return condition_on_traits(s, outcome, exposures, bxy, rg[1:, 1:], h2, intercepts), Conditioning(bxy, joint, h2, rg[1:, 1:], intercepts)


@dataclass
class Region:
    """Summary rows of a stretch of markers, sorted by position, with their LD reference: r of pairs inside the window."""

    sid: np.ndarray
    b: np.ndarray
    se: np.ndarray
    n: np.ndarray
    h: np.ndarray
    v: np.ndarray
    r: np.ndarray
    vp: float

    @property
    def d(self) -> np.ndarray:
        return self.h * self.n

    def joint_matrix(self, chosen: list[int]) -> np.ndarray:
        n, h = self.n[chosen], self.h[chosen]
        b = self.r[np.ix_(chosen, chosen)] * np.minimum.outer(n, n) * np.sqrt(np.outer(h, h))
        np.fill_diagonal(b, h * n)
        return b

    def collinear(self, chosen: list[int], most: float = 0.9) -> bool:
        r = self.r[np.ix_(chosen, chosen)]
        w = np.linalg.eigvalsh(r)
        return w[0] <= 0 or np.sqrt(w[-1] / w[0]) > 30 or (1 - 1 / np.diag(np.linalg.inv(r))).max() > most

    def joint(self, chosen: list[int]) -> tuple[np.ndarray, np.ndarray]:
        inverse = np.linalg.inv(self.joint_matrix(chosen))
        return inverse @ (self.d[chosen] * self.b[chosen]), np.sqrt(np.diag(inverse) * self.vp)

    def conditional(self, chosen: list[int], most: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
        """Effects and errors of all markers given the chosen; nan for the chosen and what they nearly tell."""
        inner = np.linalg.inv(self.joint_matrix(chosen))
        z = self.r[:, chosen] * np.minimum.outer(self.n, self.n[chosen]) * np.sqrt(np.outer(self.h, self.h[chosen]))
        told = ((self.r[:, chosen] @ np.linalg.inv(self.r[np.ix_(chosen, chosen)])) * self.r[:, chosen]).sum(axis=1)
        b = self.b - (z @ inner @ (self.d[chosen] * self.b[chosen])) / self.d
        se = np.sqrt(self.vp / self.d)
        out = told >= most
        out[chosen] = True
        b[out] = se[out] = np.nan
        return b, se

    def stepwise(self, most_p: float = 5e-8, most: float = 0.9, top: int | None = None) -> list[int]:
        """Forward by the least conditional p, backward by the greatest joint p, until neither moves."""
        chi = (self.b / self.se) ** 2
        first = int(np.argmax(chi))
        if chi2_tail(float(chi[first])) > most_p:
            return []
        chosen, barred = [first], set()
        while top is None or len(chosen) < top:
            b, se = self.conditional(chosen, most)
            chi = np.nan_to_num((b / se) ** 2, nan=-1)
            chi[list(barred)] = -1
            k = int(np.argmax(chi))
            if chi[k] < 0 or chi2_tail(float(chi[k])) > most_p:
                break
            if self.collinear([*chosen, k], most):
                barred.add(k)
                continue
            chosen.append(k)
            while len(chosen) > 1:
                bj, sj = self.joint(chosen)
                p = [chi2_tail(float((x / s) ** 2)) for x, s in zip(bj, sj)]
                worst = int(np.argmax(p))
                if p[worst] <= most_p:
                    break
                barred.add(chosen.pop(worst))
        return sorted(chosen)


def instrument_ld(sids, pairs, n: int, most_r2: float = 0.05, fdr: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(kept, r): instruments that stay and their correlations, of which those that chance explains are zero.

    pairs: a pandas frame (sid1, sid2, r) of all pairs of sids, of any chromosomes, over n individuals. Of each pair with
    r2 over most_r2 the one in more such pairs goes, of a tie the later. Of the rest, r is zero where the
    Benjamini-Hochberg rate of its p-value, of r2 n as chi-square, is at least fdr."""
    sids = np.asarray(sids)
    place = {s: k for k, s in enumerate(sids)}
    r = np.eye(len(sids))
    i, j = pairs["sid1"].map(place).to_numpy(int), pairs["sid2"].map(place).to_numpy(int)
    r[i, j] = r[j, i] = pairs["r"]
    over = (r * r > most_r2) & ~np.eye(len(sids), dtype=bool)
    degree = over.sum(axis=1)
    a, b = np.nonzero(np.tril(over))
    gone = np.where(degree[a] < degree[b], b, a)
    kept = np.setdiff1d(np.arange(len(sids)), gone)
    r = r[np.ix_(kept, kept)]
    i, j = np.tril_indices(len(kept), -1)
    p = np.array([chi2_tail(float(v)) for v in r[i, j] ** 2 * n])
    down = np.argsort(-p, kind="stable")
    rate = np.empty(len(p))
    rate[down] = np.minimum.accumulate(np.minimum(1.0, p[down] * len(p) / np.arange(len(p), 0, -1)))
    zero = rate >= fdr
    r[i[zero], j[zero]] = r[j[zero], i[zero]] = 0
    return kept, r


def gsmr(bzx, bzx_se, bzy, bzy_se, r: np.ndarray | None = None, heidi_p: float = 0.01, heidi: str = "mean", global_p: float = 0.01) -> dict:
    """Effect of exposure on outcome over instruments: generalised least-squares mean of bzy / bzx, with the covariance of
    ratios from both errors and LD; instruments whose ratio departs (HEIDI) are left out first.

    heidi: from the `mean`, the worst at a time; from the `top` instrument of the middle fifth, in one pass; or
    `iterated`, from a top that is chosen anew each time, and then all together by the global test at global_p, whose
    p-value is global_p of the result (else None)."""
    if heidi not in ("mean", "top", "iterated"):
        raise ValueError(f"unknown form {heidi!r}")
    bzx, bzx_se, bzy, bzy_se = (np.asarray(v, float) for v in (bzx, bzx_se, bzy, bzy_se))
    r = np.eye(len(bzx)) if r is None else r
    keep, whole = np.arange(len(bzx)), None
    if heidi != "mean" and heidi_p > 0:
        ratio, chi, cov = bzy / bzx, (bzx / bzx_se) ** 2, hd.ratio_covariance(bzx, bzx_se, bzy, bzy_se, r)
        if heidi == "top":
            keep = hd.against_top(ratio, chi, cov, heidi_p)
        else:
            keep, whole = hd.iterated(ratio, chi, (bzy / bzy_se) ** 2, cov, heidi_p, global_p)

    def mean(k: np.ndarray) -> tuple[float, float, np.ndarray]:
        ratio = bzy[k] / bzx[k]
        inv_y, inv_x = bzy_se[k] / bzx[k], bzx_se[k] / bzx[k]
        cov = r[np.ix_(k, k)] * (np.outer(inv_y, inv_y) + np.median(ratio) ** 2 * np.outer(inv_x, inv_x))
        w = np.linalg.solve(cov + 1e-12 * np.eye(len(k)), np.ones(len(k)))
        return float(w @ ratio / w.sum()), float(1 / np.sqrt(w.sum())), cov

    while True:
        b, se, cov = mean(keep)
        w = np.linalg.solve(cov + 1e-12 * np.eye(len(keep)), np.ones(len(keep)))
        diff = bzy[keep] / bzx[keep] - b
        var = np.diag(cov) + se * se - 2 * (cov @ w) * se * se
        p = np.array([chi2_tail(float(d * d / v)) if v > 0 else 1.0 for d, v in zip(diff, var)])
        worst = int(np.argmin(p))
        if heidi != "mean" or heidi_p <= 0 or p[worst] >= heidi_p or len(keep) <= 3:
            break
        keep = np.delete(keep, worst)
    return {"bxy": b, "se": se, "p": chi2_tail((b / se) ** 2), "n": len(keep), "kept": keep, "global_p": whole}


def selected_ld(g: DataFrame, selected: DataFrame) -> DataFrame:
    """(sid1, sid2, r), sid1 < sid2, of all pairs of selected(sid), whatever their chromosomes. A selection is a handful
    of markers in a group of its own; those of whole chromosomes belong to linkage.window_pairs."""
    at_one_place = selected.select("sid", F.lit(0).alias("chr"), F.lit(0).alias("bp"))
    return window_pairs(g.join(selected.select("sid"), "sid", "left_semi"), at_one_place, 0, "cosine")


def gsmr_traits(s: DataFrame, g: DataFrame, snp: DataFrame, exposures: list[str], outcomes: list[str], store, direction: str = "forward", least_chi2: float = 29.7168, least: int = 10, window: int = 10_000_000, heidi_p: float = 0.01, heidi: str = "mean") -> tuple[DataFrame, DataFrame]:
    """(results, instruments) of every exposure on every outcome (`forward`), the other way round (`reverse`) or `both`.

    s: (sid, trait, b, se, chi2), alleles aligned. results: (exposure, outcome, bxy, se, p, n), null where fewer than
    `least` instruments are left; instruments: (exposure, outcome, sid, outlier), outlier for those that HEIDI, in the form
    that gsmr() describes, leaves out. A pair's candidates have usable rows in both traits and reach least_chi2 in the exposure. LD is made once, of all
    exposures' candidates; the instruments of a pair are few (one a clump) and come to the driver.
    """
    if direction not in ("forward", "reverse", "both"):
        raise ValueError(f"no direction {direction}")
    pairs = [(x, y) for x in exposures for y in outcomes] if direction != "reverse" else []
    pairs += [(y, x) for y in outcomes for x in exposures] if direction != "forward" else []
    usable = s.where("b is not null and se > 0")
    strong = usable.where(F.col("trait").isin(sorted({x for x, _ in pairs})) & (F.col("chi2") >= least_chi2) & (F.col("b") != 0))
    few = store(strong.select("sid").distinct())
    near = store(window_pairs(g.join(few, "sid", "left_semi"), snp.join(few, "sid", "left_semi"), window, "mean"))
    n = g.select("iid").distinct().count()
    results, used = [], []
    for x, y in pairs:
        one = strong.where(F.col("trait") == x).select("sid", F.col("b").alias("bzx"), F.col("se").alias("bzx_se"), "chi2")
        both = store(one.join(usable.where(F.col("trait") == y).select("sid", F.col("b").alias("bzy"), F.col("se").alias("bzy_se")), "sid"))
        lead = store(clump(both.select("sid", "chi2"), near, snp, least_chi2).select("sid"))
        rows = both.join(lead, "sid").orderBy("sid").toPandas()
        kept, r = instrument_ld(rows["sid"], selected_ld(g, lead).toPandas(), n)
        rows = rows.iloc[kept]
        if len(rows) < max(least, 2):
            results.append((x, y, None, None, None, len(rows)))
            continue
        found = gsmr(rows["bzx"], rows["bzx_se"], rows["bzy"], rows["bzy_se"], r, heidi_p, heidi)
        stays = set(found["kept"])
        used += [(x, y, int(sid), k not in stays) for k, sid in enumerate(rows["sid"])]
        results.append((x, y, float(found["bxy"]), float(found["se"]), float(found["p"]), int(found["n"])) if len(stays) >= max(least, 2) else (x, y, None, None, None, len(stays)))
    spark = s.sparkSession
    return spark.createDataFrame(results, "exposure string, outcome string, bxy double, se double, p double, n int"), spark.createDataFrame(used, "exposure string, outcome string, sid long, outlier boolean")


def probe_correlations(probes: DataFrame) -> DataFrame:
    """(probe1, probe2, r) over individuals with both, probe1 < probe2."""
    a, b = probes.where("val is not null").alias("a"), probes.where("val is not null").alias("b")
    j = a.join(b, (F.col("a.iid") == F.col("b.iid")) & (F.col("a.probe") < F.col("b.probe")))
    return j.groupBy(F.col("a.probe").alias("probe1"), F.col("b.probe").alias("probe2")).agg(F.corr("a.val", "b.val").alias("r"))


def probe_blup(b: np.ndarray, r: np.ndarray, n: float, lam: float) -> np.ndarray:
    """(R + diag)^-1 b with diag = 1 + m (1 / lam - 1) / n."""
    m = len(b)
    a = np.array(r, float)
    np.fill_diagonal(a, 1 + m * (1 / lam - 1) / n)
    return np.linalg.solve(a, b)


def top_of_middle(s: DataFrame, bins: int = 5) -> DataFrame:
    """The marker of the greatest chi2 among those whose ratio by / bx lies in the middle of so many quantile bins; s has
    sid, bx, by and chi2."""
    ratio = F.col("by") / F.col("bx")
    low, high = (bins // 2) / bins, (bins // 2 + 1) / bins
    q = F.broadcast(s.agg(F.percentile(ratio, F.lit(low)).alias("lo"), F.percentile(ratio, F.lit(high)).alias("hi")))
    j = s.join(q).where((ratio >= F.col("lo")) & (ratio <= F.col("hi")))
    return j.agg(F.max(F.struct("chi2", (-F.col("sid")).alias("minus"))).alias("t")).select((-F.col("t.minus")).alias("sid"), F.col("t.chi2").alias("chi2"))


def pc_adjust(s: DataFrame, pcs: DataFrame, values: dict[int, float], pairs: DataFrame) -> DataFrame:
    """Effects without what principal components carry: (sid, b, bc). s: sid, b, freq, n; pcs: (sid, k, b), effects of
    markers on each component; values: eigenvalues.

    A component's effect on the trait is n times the sum over markers of products of standardised effects, over number and
    eigenvalue; what it carries to a marker is averaged over the markers of the LD window, weighted by r."""
    h = 2 * F.col("freq") * (1 - F.col("freq"))
    lam = F.broadcast(s.sparkSession.createDataFrame([(k, float(v)) for k, v in values.items()], "k int, lam double"))
    t = s.select("sid", "b", "n", F.sqrt(h).alias("sd"))
    j = pcs.select("sid", "k", F.col("b").alias("bk")).join(t, "sid")
    bxy = j.groupBy("k").agg((F.avg("n") * F.sum(F.col("sd") * F.col("bk") * F.col("sd") * F.col("b")) / F.count("*")).alias("t")).join(lam, "k").select("k", (F.col("t") / F.col("lam")).alias("bxy"))
    carried = j.join(F.broadcast(bxy), "k").groupBy("sid", "sd").agg(F.sum(F.col("bxy") * F.col("bk") * F.col("sd")).alias("delta"))
    both = pairs.unionByName(pairs.select(F.col("sid2").alias("sid1"), F.col("sid1").alias("sid2"), "r")).unionByName(carried.select(F.col("sid").alias("sid1"), F.col("sid").alias("sid2"), F.lit(1.0).alias("r")))
    near = both.join(carried.select(F.col("sid").alias("sid2"), "delta"), "sid2").groupBy(F.col("sid1").alias("sid")).agg((F.sum(F.col("r") * F.col("delta")) / F.count("*")).alias("w"))
    return t.join(near, "sid").select("sid", "b", (F.col("b") - F.col("w") / F.col("sd")).alias("bc"))


def probe_stepwise(b: np.ndarray, se: np.ndarray, r: np.ndarray, n: np.ndarray, vp: float = 1.0, most_p: float = 5e-6, most: float = 0.9) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Stepwise choice among probes by their correlations: their numbers, joint effects and errors."""
    m = len(b)
    g = Region(np.arange(m), np.asarray(b, float), np.asarray(se, float), np.asarray(n, float), np.ones(m), np.ones(m), np.asarray(r, float), vp)
    chosen = g.stepwise(most_p, most)
    joint = g.joint(chosen) if chosen else (np.zeros(0), np.zeros(0))
    return chosen, *joint
