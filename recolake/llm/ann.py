"""Approximate nearest neighbours by collision counting.

Each of PROJECTIONS random directions keeps its vectors' projections in one sorted array. A query opens a window
around its own projection in every array and widens all windows step by step (virtual rehashing: a wider window is
the next coarser hash bucket, centred on the query). A vector collides where it lies in the window; at THRESHOLD x
PROJECTIONS collisions it is verified with the exact cosine. The search ends when the k-th best verified vector lies so near
that any vector as near would have reached the threshold at this width with CONFIDENCE standard deviations to spare.

Vectors are dealt into shards of about SHARD_ROWS rows by a hash of the id; queries, in groups of about GROUP_ROWS, visit
every shard, and the k best of each shard are merged. Every vector is indexed, nothing is capped, and a task
holds one shard and one group.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without an id,
take no part; vectors of different lengths are never compared; ties go to the smaller id; rows that repeat a
query's id are not its candidates, other repeated rows are candidates each; of repeated query rows the smallest vector asks;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

PROJECTIONS = 128
THRESHOLD = 0.6
CONFIDENCE = 1.3
FIRST_WIDTH, WIDEN = 0.3, 1.15
SHARD_ROWS = 16_384
GROUP_ROWS = 1024
SEED = 7


def _reach() -> float:
    """Window half-width over distance at which a collision has the threshold's probability and the margin."""
    p = THRESHOLD + CONFIDENCE * math.sqrt(THRESHOLD * (1 - THRESHOLD) / PROJECTIONS)
    return NormalDist().inv_cdf((1 + p) / 2)


class CollisionIndex:
    """Sorted projections of the vectors (rows of ``x``, float64, none zero) with their ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.norms = np.sqrt((x * x).sum(axis=1))
        self.directions = np.random.default_rng(SEED).standard_normal((x.shape[1], PROJECTIONS))
        p = ((x / self.norms[:, None]) @ self.directions).T
        self.order = np.argsort(p, axis=1).astype(np.int32)
        self.sorted = np.take_along_axis(p, self.order, axis=1)

    def cosines(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact cosines, each row summed in the same order wherever it stands."""
        return (self.x[rows] * q).sum(axis=1) / (self.norms[rows] * math.sqrt((q * q).sum()))

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the ids and cosines of the k nearest found, nearest first."""
        n = len(self.ids)
        centre = ((q / np.sqrt((q * q).sum(axis=1))[:, None]) @ self.directions).T
        low = np.stack([np.searchsorted(s, c) for s, c in zip(self.sorted, centre, strict=True)])
        high = low.copy()
        hits, verified = np.zeros((len(q), n), np.uint8), np.zeros((len(q), n), bool)
        scores = np.full((len(q), n), -np.inf)
        active, width, need = np.arange(len(q)), FIRST_WIDTH, math.ceil(THRESHOLD * PROJECTIONS)
        reach, result = _reach(), [None] * len(q)
        while len(active):
            new_low = np.stack([np.searchsorted(s, c[active] - width) for s, c in zip(self.sorted, centre, strict=True)])
            new_high = np.stack([np.searchsorted(s, c[active] + width, "right") for s, c in zip(self.sorted, centre, strict=True)])
            going = []
            for column, j in enumerate(active):
                parts = []
                for order, a, b, c, d in zip(self.order, new_low[:, column].tolist(), low[:, j].tolist(), high[:, j].tolist(),
                                             new_high[:, column].tolist(), strict=True):
                    parts += (order[a:b], order[c:d])
                hits[j] += np.bincount(np.concatenate(parts), minlength=n).astype(np.uint8)
                fresh = np.flatnonzero((hits[j] >= need) & ~verified[j])
                verified[j, fresh] = True
                scores[j, fresh] = np.where(self.ids[fresh] == q_ids[j], -np.inf, self.cosines(fresh, q[j]))
                done = np.flatnonzero(scores[j] > -np.inf)
                kth = np.partition(scores[j, done], len(done) - k)[len(done) - k] if len(done) >= k else -2.0
                if verified[j].all() or math.sqrt(max(0.0, 2 - 2 * kth)) * reach <= width:
                    done = done[scores[j, done] >= kth]
                    best = done[np.lexsort((self.ids[done], -scores[j, done]))][:k]
                    result[j] = (self.ids[best], scores[j, best])
                else:
                    going.append(column)
            low[:, active], high[:, active] = new_low, new_high
            active, width = active[going], width * WIDEN
        return result


def _vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array<double>), n: the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists("v", lambda x: x != 0)).withColumn("n", F.size("v"))


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found among the rows of the table."""
    rows = stored(_vectors(table, id_col, vector_col), "vectors")
    asked = _vectors(queries, id_col, vector_col).groupBy("vec_id", "n").agg(F.min("v").alias("v"))
    asked = stored(asked, "queries")
    shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    groups = max(1, math.ceil(asked.count() / GROUP_ROWS))
    shard = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int")
    group = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(groups)).cast("int")
    spread = rows.select("n", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), "vec_id", "v")
    visits = asked.select("n", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), group.alias("grp"), "vec_id", "v")

    def cell(vectors: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(asking):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        index = CollisionIndex(vectors["vec_id"].to_numpy(np.int64), np.stack(vectors["v"].to_numpy()).astype(np.float64))
        q_ids, q = asking["vec_id"].to_numpy(np.int64), np.stack(asking["v"].to_numpy()).astype(np.float64)
        found = []
        for a in range(0, len(q), 64):
            found += index.search(q_ids[a:a + 64], q[a:a + 64], k)
        return pd.DataFrame({"query_id": np.repeat(q_ids, [len(f[0]) for f in found]),
                             "vec_id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found])})
    keys = ["n", "shard", "grp"]
    best = spread.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
