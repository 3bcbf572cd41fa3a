"""Quality scores by a regularised quadratic discriminant over statistics of whole texts.

Each class is a normal distribution of transformed statistics; its covariance shrinks towards the pooled one and then
towards a multiple of the identity. A score is the logistic of the difference of the classes' log densities, each from
the Mahalanobis distance by the Cholesky factor of its covariance, which is computed once and sent to the tasks.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import materialise

#: Names of the statistics, in order.
STATISTICS = ("log_words", "word_length", "capitals", "symbols", "digits", "stops", "repeats", "variety", "top_word", "line_copies", "bare_words", "packing")
SHRINK_POOLED, SHRINK_IDENTITY = 0.1, 0.05
#: Texts are read by slices of this many characters where a statistic needs lists of words.
_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_punctuated = re.compile(r"\w[.,;:!?]?\Z").search
_drop_letters = {c: None for c in range(128) if chr(c).isalnum() or chr(c) in " .,;:?'\"()-\n\t\r\v\f"}


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a text; all are finite, and shares are smoothed so that short texts tell little."""
    words = _words(text) if text else []
    if not words:
        return [0.0] * len(STATISTICS)
    n, chars = len(words), len(text)
    counts = Counter(words)
    upper = sum(map(str.isupper, words))
    odd = text.translate(_drop_letters)
    symbols = sum(not c.isalnum() for c in set(odd)) and sum(n_ for c, n_ in Counter(odd).items() if not c.isalnum())
    digits = sum(map(text.count, "0123456789"))
    stops = text.count(".") + text.count("?")
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    copies = len(lines) - len(set(lines))
    share = lambda x, of, prior=0.0, weight=8.0: math.asinh(20 * (x + prior * weight) / (of + weight))
    packed = len(zlib.compress(text.encode(), 1)) / (chars + 40)
    return [
        math.log1p(n),
        math.log((chars + 48) / (n + 8)),
        share(upper, n),
        share(symbols, n),
        share(digits, n),
        share(stops, n, 0.08, 30.0),
        share(repeats, n),
        math.log((len(counts) + 4) / (n + 4)) / math.log(n + 4),
        share(counts.most_common(1)[0][1], n, 0.05, 30.0),
        share(copies, len(lines)),
        share(sum(map(len, words)) - sum(map(len, counts)), chars, 0.3, 400.0),
        packed,
    ]


@dataclass(frozen=True)
class Discriminant:
    """A fitted model: centre and scale of the statistics, and for classes 0 and 1 the mean, the inverse of the Cholesky
    factor and the constant of the log density (with the log of the prior)."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of class 1."""
        z = np.clip((rows - self.centre) / self.scale, -8, 8)
        density = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(labelled: DataFrame) -> Discriminant:
    """Fit on all rows of (label int 0 or 1, x array<double>): counts, sums and sums of products, added up by tasks.

    Without rows of a class, that class takes the moments of all rows, and without any rows scores are even.
    """
    d = len(STATISTICS)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            for k in (0, 1):
                x = batch.loc[batch["label"] == k, "x"]
                if len(x):
                    m = np.stack(list(x))
                    n[k] += len(m)
                    s[k] += m.sum(axis=0)
                    p[k] += m.T @ m
        flat = np.concatenate([n, s.ravel(), p.ravel()])
        yield pd.DataFrame({"at": np.arange(len(flat)), "v": flat})

    found = labelled.mapInPandas(moments, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    for r in found:
        flat[r["at"]] = r.v
    n, s, p = flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d)
    total = n.sum()
    if not total:
        return Discriminant(np.zeros(d), np.ones(d), np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
    centre = s.sum(axis=0) / total
    scale = np.sqrt(np.maximum(np.diag(p.sum(axis=0)) / total - centre**2, 1e-12))
    scale[scale < 1e-5] = 1
    covs, means = [], []
    for k in (0, 1):
        nk, sk, pk = (n[k], s[k], p[k]) if n[k] else (total, s.sum(axis=0), p.sum(axis=0))
        m = sk / nk
        means.append((m - centre) / scale)
        covs.append((pk / nk - np.outer(m, m)) / np.outer(scale, scale))
    pooled = (covs[0] * max(n[0], 1) + covs[1] * max(n[1], 1)) / (max(n[0], 1) + max(n[1], 1))
    factors, constants = [], []
    for k in (0, 1):
        c = (1 - SHRINK_POOLED) * covs[k] + SHRINK_POOLED * pooled
        c = (1 - SHRINK_IDENTITY) * c + SHRINK_IDENTITY * max(np.trace(c) / d, 1e-3) * np.eye(d)
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower))
        constants.append(math.log((n[k] + 1) / (total + 2)) - np.log(np.diag(lower)).sum())
    return Discriminant(centre, scale, np.array(means), np.array(factors), np.array(constants))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics, of each row of docs (doc_id, text)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, x array<double>")


def held_out(doc_id: str | F.Column = "doc_id", folds: int = 5) -> F.Column:
    """Rows whose labels no fit may see; rows without doc_id aren't among them (they have no labels)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % folds == 0, F.lit(False))


def train(x: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on the labels (doc_id, quality) that aren't held out; rows with other values than 0 and 1 are left out."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    return fit(x.join(known, "doc_id").select("label", "x"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold) of each row.

    Only the text makes a score; null and empty texts share one. Repeated rows score alike, and each label row of a
    repeated doc_id counts. Empty docs give an empty table, and empty labels even scores. Other columns aren't read.
    """
    x = materialise(measured(docs))
    model = x.sparkSession.sparkContext.broadcast(train(x, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(rows))], ["doc_id", "score"])

    scored = x.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that score under the threshold, columns as they were. Texts are measured once: the
    statistics are written beside the rows, which the model then reads."""
    vector = "array<double>"

    @F.pandas_udf(vector)
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    whole = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), measure(F.col("text")).alias("x")))
    model = docs.sparkSession.sparkContext.broadcast(train(whole.select(F.col("row.doc_id").cast("long").alias("doc_id"), "x"), labels))

    @F.pandas_udf("boolean")
    def good(x: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(np.stack(list(x))) >= threshold if len(x) else [], dtype=bool)

    return whole.where(good(F.col("x"))).select("row.*")
