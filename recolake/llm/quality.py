"""Quality classifier: a regularised quadratic discriminant over document statistics.

Every text becomes a vector of transformed statistics. Per class the count, mean and covariance
come from sums that Spark adds up over all labelled rows; each covariance is shrunk towards the pooled one, which counts
as one row per statistic, and the pooled one towards its mean variance by the analytic share of Ledoit and Wolf; so few rows
are trusted little. Each is factored once (Cholesky). A row's score is the posterior of class 1 from the
difference of the two Gaussian log densities (Mahalanobis distances by the cached factors).

Defined results: a null text counts as empty, and an empty text has a score like any other; labels that are null or neither
0 nor 1 are not learned from; of several labels of one doc_id the largest counts; rows of a
class that has fewer than two labelled rows leave the model without shape, and every score is then the
share of class 1 among labels (0.5 without any). An empty table gives an empty result. Columns other
than the id and the text are never read; repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stored

LEAST_SHRINKAGE = 0.02
THRESHOLD = 0.3

_SYMBOL = re.compile(r"[^\w\s.,;:'\"()?-]")
_END = re.compile(r"[.!?](?:\s|$)")

STATISTICS = ("log words", "mean word length", "spread of word lengths", "upper case", "digits", "symbols", "punctuation",
              "variety of words", "immediate repeats", "sentence ends", "repeated lines", "commonest word")


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text: logarithms of sizes, square roots of shares."""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(STATISTICS)
    lower = text.lower()
    upper = 0
    if lower != text and len(lower) == len(text):
        upper = int((np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), "<u4")
                     != np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")).sum())
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = text.split("\n")
    ascii_counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=128)
    digits = ascii_counts[48:58].sum()
    marks = ascii_counts[33:48].sum() + ascii_counts[58:65].sum() + ascii_counts[91:97].sum() + ascii_counts[123:127].sum()
    return [
        math.log1p(n), math.log(sizes.mean()), math.log1p(sizes.std()), math.sqrt(upper / chars),
        math.sqrt(digits / chars), math.sqrt(len(_SYMBOL.findall(text)) / chars), math.sqrt(marks / chars),
        math.log1p(len(counts)) / math.log1p(n), math.sqrt(sum(map(eq, words, words[1:])) / n),
        math.sqrt(len(_END.findall(text)) / n), math.sqrt(1 - len(set(lines)) / len(lines)),
        math.sqrt(max(counts.values()) / n),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: the statistics of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": [statistics(t if isinstance(t, str) else "") for t in b["text"]]})
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """log prior ratio, and per class the mean, the inverse Cholesky factor and half the log determinant."""
    prior: float
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()
    half_logdets: tuple[float, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for every row of x."""
        logit = np.full(len(x), self.prior)
        for sign, m, f, d in zip((-1, 1), self.means, self.factors, self.half_logdets, strict=True) if self.means else ():
            logit -= sign * (0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) + d)
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def moments(rows: DataFrame, centres: np.ndarray | None = None, scale: np.ndarray | None = None) -> dict[int, tuple[float, np.ndarray, np.ndarray, float]]:
    """Per class of rows (x, y), with x less the class's centre and over the scale: count, sum, sum of outer products, and sum of the fourth
    powers of the lengths, added up by Spark; what reaches the driver is of the size of one covariance matrix per class."""
    d = len(STATISTICS)
    centres, scale = np.zeros((2, d)) if centres is None else centres, np.ones(d) if scale is None else scale

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 2 + d + d * d))
        for b in batches:
            x, y = np.array(b["x"].tolist()).reshape(-1, d), b["y"].to_numpy()
            for c in (0, 1):
                own = (x[y == c] - centres[c]) / scale
                fourth = ((own ** 2).sum(axis=1) ** 2).sum(keepdims=True)
                total[c] += np.concatenate(([len(own)], fourth, own.sum(axis=0), (own.T @ own).ravel()))
        yield pd.DataFrame({"y": np.repeat([0, 1], total.shape[1]), "at": np.tile(np.arange(total.shape[1]), 2),
                            "value": total.ravel()})
    sums = rows.mapInPandas(run, "y int, at int, value double").groupBy("y", "at").agg(F.sum("value").alias("value"))
    total = np.zeros((2, 2 + d + d * d))
    for r in sums.collect():
        total[r.y, r.at] = r.value
    return {c: (total[c, 0], total[c, 2:2 + d], total[c, 2 + d:].reshape(d, d), total[c, 1]) for c in (0, 1)}


def shrinkage(n: float, spread: np.ndarray, fourth: float, target: np.ndarray) -> float:
    """How far to move a covariance of n centred rows towards a target (Ledoit and Wolf): its variance, from the fourth powers of the
    rows' lengths, over its squared distance from the target. Few rows give a share near 1, many a share near 0."""
    noise = (fourth / n - (spread ** 2).sum()) / n
    away = ((spread - target) ** 2).sum()
    return float(min(1.0, max(0.0, noise) / away)) if away > 0 else 1.0


def fit(rows: DataFrame) -> Discriminant:
    """From rows (x, y); the first pass finds centres and scales, the second the centred moments."""
    first = moments(rows)
    n0, n1 = first[0][0], first[1][0]
    if min(n0, n1) < 2:
        return Discriminant(math.log((n1 + 0.5) / (n0 + 0.5)) if n0 + n1 else 0.0)
    means = np.array([s / n for n, s, *_ in first.values()])
    variance = sum(np.diag(q) - n * mu ** 2 for (n, _, q, _), mu in zip(first.values(), means, strict=True)) / (n0 + n1)
    scale = np.sqrt(np.maximum(variance, 1e-9))
    m = moments(rows, means, scale)
    spreads = [q / n for n, _, q, _ in m.values()]
    pooled = (n0 * spreads[0] + n1 * spreads[1]) / (n0 + n1)
    sphere = np.eye(len(pooled)) * max(np.trace(pooled) / len(pooled), 1e-9)
    to_sphere = max(LEAST_SHRINKAGE, shrinkage(n0 + n1, pooled, m[0][3] + m[1][3], sphere))
    target = (1 - to_sphere) * pooled + to_sphere * sphere
    factors, dets = [], []
    for c, s in enumerate(spreads):
        share = len(s) / (m[c][0] + len(s))
        factor = np.linalg.cholesky((1 - share) * s + share * target)
        factors.append(np.linalg.inv(factor) / scale)
        dets.append(float(np.log(np.diag(factor)).sum()))
    return Discriminant(math.log(n1 / n0), tuple(means), tuple(factors), tuple(dets))


def score(feats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score of rows (doc_id, x)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.score(np.array(b["x"].tolist()))})
    return feats.mapInPandas(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learns from labels of rows not held out."""
    feats = stored(features(docs, id_col, text_col), "quality-features")
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
             .filter("y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y")).filter(~held_out()))
    model = fit(feats.join(known, "doc_id").select("x", "y"))
    return score(feats, model).select("doc_id", held_out().alias("held_out"), "score",
                                      (F.col("score") >= threshold).cast("int").alias("predicted"))
