"""Linkage disequilibrium: correlations of marker pairs in windows and blocks, scores, pruning, clumping, search.

Three scalings of r are in use: `window` (sum of products of 2pq-standardised values over n - 1), `cosine` (of centred
columns, missing at the mean) and `mean` (products over n). Markers are packed by chromosome stretch into dense columns
for matrix products, so no row is made for an individual and marker pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions.stats import t_tail
from lociflow.operators.relatedness import CELLS


#: Stands for a missing call among whole numbers.
MISSING = 255


def standard_columns(x: np.ndarray, scaling: str) -> np.ndarray:
    """Columns of genotypes (nan: missing) centred, missing at 0, scaled for products to be r."""
    n = len(x)
    mu = np.nanmean(x, axis=0)
    z = np.nan_to_num(x - mu)
    if scaling == "cosine":
        length = np.sqrt((z * z).sum(axis=0))
    else:
        length = np.sqrt(mu * (1 - mu / 2) * (n - 1 if scaling == "window" else n))
    return np.divide(z, length, out=np.zeros_like(z), where=length > 1e-15)


def packed(g: DataFrame, snp: DataFrame | None = None, ids: np.ndarray | None = None) -> DataFrame:
    """(sid, chr, bp, x): x has a marker's genotypes by iid over all individuals of g, nan where missing or without a row.
    Without snp, chr and bp are 0. ids: the individuals, sorted, where they are known; g must have no others.

    Tasks gather cells to runs by marker before the shuffle, a row for each task and marker. A run's calls that are whole
    numbers under 255 are a byte each, others 8, and its individuals 4, or 4 in all where they follow one another; either
    is compressed. The individuals' numbers, 8 bytes each, go to every task.
    """
    if ids is None:
        ids = np.sort(g.where("iid is not null").select(F.col("iid").cast("long")).distinct().toPandas()["iid"].to_numpy(np.int64))
    known = g.sparkSession.sparkContext.broadcast(ids)

    def runs(table: pa.Table) -> pa.RecordBatch:
        sid, iid, v = (table[c].to_numpy() for c in ("sid", "iid", "v"))
        order = np.argsort(sid, kind="stable")
        sid, at, v = sid[order], np.searchsorted(known.value, iid[order]).astype(np.int32), v[order]
        starts = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1])))
        ends = [*starts[1:], len(sid)]
        missing = np.isnan(v)
        code = np.where(missing, MISSING, v)
        if whole_numbers := bool((missing | (code < MISSING) & (code >= 0) & (code == np.floor(code))).all()):
            v = code.astype(np.uint8)
        follows = np.concatenate(([0], np.cumsum(np.diff(at) != 1)))
        cut = lambda u, ends: pa.array([pa.compress(u[i:j].tobytes(), "zstd", asbytes=True) for i, j in zip(starts, ends)], pa.binary())
        first = [i + 1 if follows[i] == follows[j - 1] else j for i, j in zip(starts, ends)]
        kinds = [pa.array(np.subtract(ends, starts).astype(np.int32)), pa.array([whole_numbers] * len(starts))]
        return pa.RecordBatch.from_arrays([pa.array(sid[starts]), *kinds, pa.array(np.subtract(first, starts).astype(np.int32)), cut(at, first), cut(v, ends)], ["sid", "n", "whole", "places", "at", "v"])

    def read(run: dict) -> tuple[np.ndarray, np.ndarray]:
        n, places = run["n"], run["places"]
        at = np.frombuffer(pa.decompress(run["at"], 4 * places, "zstd"), np.int32)
        v = np.frombuffer(pa.decompress(run["v"], n if run["whole"] else 8 * n, "zstd"), np.uint8 if run["whole"] else np.float64)
        return at if places == n else at[0] + np.arange(n), np.where(v == MISSING, np.nan, v) if run["whole"] else v

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CELLS:
                yield runs(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield runs(pa.Table.from_batches(held))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(known.value)
        step = max(1, CELLS * 4 // max(n, 1))
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                x = np.full((part.num_rows, n), np.nan)
                for k, found in enumerate(part.column("r").to_pylist()):
                    for run in found:
                        at, v = read(run)
                        x[k, at] = v
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * n)
                yield pa.RecordBatch.from_arrays([part.column("sid"), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["sid", "x"])

    cells = g.where("iid is not null and sid is not null").select(F.col("sid").cast("long"), F.col("iid").cast("long"), F.coalesce(F.col("gt").cast("double"), F.lit(float("nan"))).alias("v"))
    run = "n int, whole boolean, places int, at binary, v binary"
    parts = cells.mapInArrow(gather, f"sid long, {run}").groupBy("sid").agg(F.collect_list(F.struct("n", "whole", "places", "at", "v")).alias("r"))
    markers = parts.mapInArrow(whole, "sid long, x array<double>")
    if snp is None:
        return markers.select("sid", F.lit(0).alias("chr"), F.lit(0).alias("bp"), "x")
    return markers.join(snp.select("sid", "chr", "bp"), "sid")


def stretches(markers: DataFrame, window: int) -> DataFrame:
    """Markers dealt to stretches (chr, bin) of `window` bp, each with a copy in the bin before, so that every pair
    within the window meets in the bin of its first marker; lead says that a row is at home."""
    home = F.floor(F.col("bp") / (window + 1))
    both = markers.withColumn("bin", F.explode(F.array(home, home - 1)))
    return both.withColumn("lead", F.col("bin") == home)


def window_pairs(g: DataFrame, snp: DataFrame, window: int = 1_000_000, scaling: str = "window", least_r2: float = 0.0) -> DataFrame:
    """(sid1, sid2, r) for pairs of a chromosome at most `window` bp apart, sid1 the earlier by (bp, sid)."""

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bp", "sid"])
        z = standard_columns(np.stack(list(pdf["x"])).T, scaling)
        varies = (z != 0).any(axis=0)  # a constant marker has no correlation
        pdf, z = pdf[varies], z[:, varies]
        bp, sid, lead = pdf["bp"].to_numpy(), pdf["sid"].to_numpy(), pdf["lead"].to_numpy()
        out = []
        for s in range(0, len(pdf), 512):
            r = z[:, s : s + 512].T @ z
            i, j = np.nonzero((np.arange(len(pdf))[None, :] > np.arange(s, min(s + 512, len(pdf)))[:, None]) & (bp[None, :] - bp[s : s + 512, None] <= window) & lead[s : s + 512, None] & (r * r >= least_r2))
            out.append(pd.DataFrame({"sid1": sid[i + s], "sid2": sid[j], "r": r[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"sid1": [], "sid2": [], "r": []})

    return stretches(packed(g, snp), window).groupBy("chr", "bin").applyInPandas(pairs, "sid1 long, sid2 long, r double")


def blocks(snp: DataFrame, window: int = 10_000_000, least_markers: int = 1, gap: int = 1_000_000) -> DataFrame:
    """(sid, chr, bp, block, second): consecutive markers in blocks. A block ends at a gap or where its span exceeds the
    window; a short tail joins the block before it. second: blocks between the midpoints of neighbouring blocks."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bp", "sid"]).reset_index(drop=True)
        bp = pdf["bp"].to_numpy()
        starts, run = [0], [0]
        for i in range(1, len(bp)):
            jump = bp[i] - bp[i - 1] > gap
            if jump or (bp[i] - bp[starts[-1]] > window and i - starts[-1] >= least_markers):
                run = [i] if jump else run
                starts.append(i)
        ends = [*starts[1:], len(bp)]
        merged: list[list[int]] = []
        for s, e in zip(starts, ends):
            short = bp[e - 1] - bp[s] <= window / 2 or e - 1 - s <= least_markers / 2
            if merged and short and bp[s] - bp[s - 1] <= gap:
                merged[-1][1] = e
            else:
                merged.append([s, e])
        block, second = np.zeros(len(bp), np.int64), np.full(len(bp), -1)
        for k, (s, e) in enumerate(merged):
            block[s:e] = k
        for k, ((s, e), (s2, e2)) in enumerate(zip(merged, merged[1:])):
            if bp[s2] - bp[e - 1] <= gap:
                second[(s + e) // 2 : (s2 + e2) // 2] = k
        return pdf.assign(block=block, second=second)[["sid", "chr", "bp", "block", "second"]]

    return snp.select("sid", "chr", "bp").groupBy("chr").applyInPandas(cut, "sid long, chr int, bp int, block long, second long")


def block_pairs(g: DataFrame, snp: DataFrame, placed: DataFrame, scaling: str = "cosine") -> DataFrame:
    """(sid1, sid2, r) for ordered pairs in a common block, of either set, each once."""

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sid")
        z = standard_columns(np.stack(list(pdf["x"])).T, scaling)
        r, sid = z.T @ z, pdf["sid"].to_numpy()
        varies = (z != 0).any(axis=0)
        keep = ~np.eye(len(sid), dtype=bool) & varies[:, None] & varies[None, :]
        if pdf["kind"].iat[0] == 1:  # pairs of one first block are there already
            b = pdf["own"].to_numpy()
            keep &= b[:, None] != b[None, :]
        i, j = np.nonzero(keep)
        return pd.DataFrame({"sid1": sid[i], "sid2": sid[j], "r": r[i, j]})

    m = packed(g, snp).join(placed.select("sid", "block", "second"), "sid")
    both = m.select("sid", "chr", "x", F.col("block").alias("own"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("block").alias("b")), F.struct(F.lit(1).alias("kind"), F.col("second").alias("b")))).alias("k"))
    return both.select("sid", "chr", "x", "own", "k.kind", "k.b").where("b >= 0").groupBy("chr", "kind", "b").applyInPandas(pairs, "sid1 long, sid2 long, r double")


def ld_scores(pairs: DataFrame, snp: DataFrame, least_r2: float = 0.0, adjust_n: int | None = None) -> DataFrame:
    """sid, mean_rsq, snp_num, max_rsq and ldscore = 1 + mean * number, over partners with r2 >= least_r2; adjust_n: the
    sample size by which r2 loses (1 - r2) / (n - 2)."""
    r2 = F.col("r") * F.col("r")
    value = r2 if adjust_n is None else r2 - (1 - r2) / (adjust_n - 2)
    s = pairs.groupBy(F.col("sid1").alias("sid")).agg(F.avg(F.when(r2 >= least_r2, value)).alias("mean_rsq"), F.count(F.when(r2 >= least_r2, 1)).alias("snp_num"), F.max(r2).alias("max_rsq"))
    j = snp.select("sid").join(s, "sid", "left")
    mean, num = F.coalesce("mean_rsq", F.lit(0.0)), F.coalesce("snp_num", F.lit(0))
    return j.select("sid", mean.alias("mean_rsq"), num.alias("snp_num"), F.col("max_rsq"), (1 + mean * num).alias("ldscore"))


def ld_scores_by_set(pairs: DataFrame, sets: DataFrame, least_r2: float = 0.0) -> DataFrame:
    """Scores of each marker against the partners of each set; sets(name, sid)."""
    r2 = F.col("r") * F.col("r")
    j = pairs.join(sets.select(F.col("sid").alias("sid2"), "name"), "sid2").where(r2 >= least_r2)
    return j.groupBy("name", F.col("sid1").alias("sid")).agg(F.avg(r2).alias("mean_rsq"), F.count("*").alias("snp_num"), F.max(r2).alias("max_rsq"), F.sum(r2).alias("ldscore"))


def regional_scores(scores: DataFrame, snp: DataFrame, segment: int = 100_000) -> DataFrame:
    """Mean score of a marker's segment, averaged over two staggered sets of segments."""
    j = scores.join(snp.select("sid", "chr", "bp"), "sid")
    one = F.avg("ldscore").over(Window.partitionBy("chr", F.floor(F.col("bp") / segment)))
    two = F.avg("ldscore").over(Window.partitionBy("chr", F.floor((F.col("bp") + segment / 2) / segment)))
    return j.withColumn("a", one).withColumn("b", two).select("sid", "ldscore", ((F.col("a") + F.col("b")) / 2).alias("ldscore_region"))


def max_and_multiple_r2(g: DataFrame, snp: DataFrame, placed: DataFrame) -> DataFrame:
    """sid, max_rsq, max_sid and multi_rsq of a marker on all others of its block, by the inverse correlation matrix."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sid")
        x = np.stack(list(pdf["x"])).T
        z, sid = standard_columns(x, "cosine"), pdf["sid"].to_numpy()
        r = z.T @ z
        w, u = np.linalg.eigh(r)
        good = w > 1e-6 * max(w.max(), 1e-12)
        inverse = (u[:, good] / w[good]) @ u[:, good].T
        multi = np.clip(1 - 1 / np.maximum(np.diag(inverse), 1.0), 0, 1)
        r2 = r * r
        np.fill_diagonal(r2, -1)
        k = r2.argmax(axis=1)
        n, m = len(x), int(good.sum())
        adjusted = 1 - (1 - multi) * (n - 1) / max(n - m, 1)
        top = r2[np.arange(len(sid)), k]
        return pd.DataFrame({"sid": sid, "max_rsq": np.where(top < 0, np.nan, top), "max_sid": np.where(top < 0, -1, sid[k]), "multi_rsq": multi, "multi_rsq_adj": adjusted})

    return packed(g, snp).join(placed.select("sid", "block"), "sid").groupBy("chr", "block").applyInPandas(solve, "sid long, max_rsq double, max_sid long, multi_rsq double, multi_rsq_adj double")


def search(pairs: DataFrame, snp: DataFrame, n: int, targets: DataFrame, alpha: float = 0.05) -> DataFrame:
    """For target markers, the partners whose correlation is significant: number, mean, median and greatest r2, and how
    far they lie. pairs hold both orders or one."""
    both = pairs.unionByName(pairs.select(F.col("sid2").alias("sid1"), F.col("sid1").alias("sid2"), "r")).dropDuplicates(["sid1", "sid2"])
    limit = _critical_r2(n, alpha)
    j = both.join(F.broadcast(targets.select(F.col("sid").alias("sid1"))), "sid1").join(snp.select(F.col("sid").alias("sid2"), "bp"), "sid2").withColumn("r2", F.col("r") * F.col("r")).where(F.col("r2") > limit)
    return j.groupBy(F.col("sid1").alias("sid")).agg(F.count("*").alias("n_snps"), F.avg("r2").alias("mean_rsq"), F.median("r2").alias("median_rsq"), F.max("r2").alias("max_rsq"), F.max(F.struct("r2", -F.col("sid2")))["col2"].alias("minus"), F.min("bp").alias("left_bp"), F.max("bp").alias("right_bp")).withColumn("max_sid", -F.col("minus")).drop("minus")


def _critical_r2(n: int, alpha: float) -> float:
    low, high = 0.0, 1.0 - 1e-12
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail((mid * (n - 2) / (1 - mid)) ** 0.5, n - 2) > alpha else (low, mid)
    return high


def prune(pairs: DataFrame, most_r2: float) -> DataFrame:
    """Markers that one pass removes: of each pair over the bound the one in more such pairs, of a tie the later."""
    over = pairs.where(F.col("r") * F.col("r") > most_r2).select(F.greatest("sid1", "sid2").alias("i"), F.least("sid1", "sid2").alias("j")).distinct()
    degree = over.select(F.explode(F.array("i", "j")).alias("sid")).groupBy("sid").agg(F.count("*").alias("d"))
    j = over.join(degree.select(F.col("sid").alias("i"), F.col("d").alias("di")), "i").join(degree.select(F.col("sid").alias("j"), F.col("d").alias("dj")), "j")
    return j.select(F.when(F.col("dj") > F.col("di"), F.col("j")).otherwise(F.col("i")).alias("sid")).distinct()


def clump(stats: DataFrame, pairs: DataFrame, snp: DataFrame, most_p_chi2: float, least_r2: float = 0.05) -> DataFrame:
    """Index markers (sid, chi2) of a greedy pass by chi2: each removes its window's markers with r2 >= least_r2. stats has
    sid, chi2; only those of at least most_p_chi2 may lead. A chromosome's candidates are one group."""
    lead = stats.where(F.col("chi2") >= most_p_chi2).join(snp.select("sid", "chr"), "sid")
    near = pairs.where(F.col("r") * F.col("r") >= least_r2)
    near = near.select("sid1", "sid2").unionByName(near.select(F.col("sid2").alias("sid1"), F.col("sid1").alias("sid2")))
    near = near.join(lead.select(F.col("sid").alias("sid1")), "sid1", "left_semi").join(lead.select(F.col("sid").alias("sid2")), "sid2", "left_semi")
    rows = lead.join(near.groupBy(F.col("sid1").alias("sid")).agg(F.collect_set("sid2").alias("near")), "sid", "left")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chi2", "sid"], ascending=[False, True])
        gone: set[int] = set()
        kept = []
        for sid, chi2, near_ in zip(pdf["sid"], pdf["chi2"], pdf["near"]):
            if sid not in gone:
                kept.append((sid, chi2))
                gone.update(near_ if near_ is not None else ())
        return pd.DataFrame(kept, columns=["sid", "chi2"])

    return rows.groupBy("chr").applyInPandas(greedy, "sid long, chi2 double")


def window_counts(snp: DataFrame, window: int) -> DataFrame:
    """How many markers follow within the window, itself included."""
    w = Window.partitionBy("chr").orderBy(F.col("bp").cast("long")).rangeBetween(0, window)
    return snp.select("sid", "chr", "bp", F.count("*").over(w).alias("n"))


def segments(snp: DataFrame, length: int = 100_000) -> DataFrame:
    """Fixed-length segments from each chromosome's first marker on: (chr, segment, start, end, n)."""
    first = F.min("bp").over(Window.partitionBy("chr"))
    return snp.withColumn("segment", F.floor((F.col("bp") - first) / length)).groupBy("chr", "segment").agg(F.min("bp").alias("start"), F.max("bp").alias("end"), F.count("*").alias("n"))


def scan(markers: DataFrame, fn: Callable[[np.ndarray, np.ndarray], pd.DataFrame], schema: str, rows: int = 1024) -> DataFrame:
    """Any function of (sids, genotypes by iid: markers x individuals, nan missing) over blocks of packed markers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), rows):
                part = b.iloc[s : s + rows]
                yield fn(part["sid"].to_numpy(), np.stack(list(part["x"])))

    return markers.mapInPandas(run, schema)
