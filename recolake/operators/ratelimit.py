"""Sliding-window rate limiting (ST8, ST9) and the hit-rate report.

Contract (trap 11): a request of key k at time t is admitted iff fewer than
``limit`` *admitted* requests of k lie in (t - window, t]; rejected requests
do not count; a null user is always admitted (not rate limited).

Admission is greedy and order dependent, so each key's requests are folded
in time order. After a pause longer than the window nothing of a key's past
counts any more, so its requests fall into independent runs (sessions split at
such gaps), and a hot key spreads over as many tasks as it has runs. The fold is
a streaming scan: rows are hash partitioned by key and run, sorted within partitions, and ``mapInPandas`` walks the sorted stream
keeping only the admitted timestamps still inside the window (at most
``limit`` values) - no key's requests are ever materialised as a group.
The scan is per key sequential by definition of greedy admission; memory is
O(limit) per task whatever the key's size, and a saturated key is skipped
through by binary search (work O(admitted * log n) instead of O(n)).
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .activity import bucket_sessions

_US = 1_000_000


def _codes(values) -> np.ndarray:
    """Numbers that are equal where the values are, nulls included."""
    return pd.factorize(values, use_na_sentinel=True)[0]


def _limit_for(limit, action):
    return limit[action] if isinstance(limit, dict) else limit


def _scan(limit, window_us: int, nkeys: int):
    """Greedy admission over a partition sorted by (key, time, tie-break).

    While fewer than ``limit`` admitted requests are in the window, the next
    request is admitted; once the window is full, every request before
    ``oldest admitted + window`` is rejected, so the scan *jumps* there with a
    binary search. Work per key is O(admitted * log n), not O(requests), which
    is what matters for a hot key sending far more than its limit.
    """
    def run(batches):
        cur = None
        admitted: deque = deque()
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            kv = [pdf[f"_k{i}"].to_numpy() for i in range(nkeys)]
            us = pdf["_us"].to_numpy().astype(np.int64)
            ok = np.zeros(n, dtype=bool)
            before = np.zeros(n, dtype=np.int64)
            change = np.zeros(n, dtype=bool)
            change[0] = True
            for v in kv:
                c = _codes(v)
                change[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], n)
            for s, e in zip(starts, ends):
                k = tuple(None if pd.isna(v[s]) else v[s] for v in kv)
                if k != cur:
                    cur = k
                    admitted.clear()
                # the last key before the run is the action
                most = _limit_for(limit, k[nkeys - 2])
                j = s
                while j < e:
                    t = us[j]
                    while admitted and admitted[0] <= t - window_us:
                        admitted.popleft()
                    if len(admitted) < most:
                        before[j] = len(admitted)
                        ok[j] = True
                        admitted.append(t)
                        j += 1
                    else:  # window full: reject up to the first request at or after expiry
                        nxt = j + int(np.searchsorted(us[j:e], admitted[0] + window_us, side="left"))
                        before[j:nxt] = most
                        j = nxt
            out = pdf.drop(columns=[f"_k{i}" for i in range(nkeys)] + ["_us"])
            out["admitted"] = ok
            out["_before"] = before
            yield out
    return run


def limit_column(limit, keys: list[str]):
    """The limit as a column: one number, or a number per value of the last key (the action)."""
    if not isinstance(limit, dict):
        return F.lit(limit)
    return F.create_map(*[F.lit(x) for kv in limit.items() for x in kv])[F.col(keys[-1])]


def rate_limit(requests: DataFrame, keys: list[str], ts_col: str, limit: int | dict,
               window_seconds: int, order_col: str | None = None) -> DataFrame:
    """Every request with ``admitted``, ``remaining`` (limit - (admitted in
    window + 1); 0 when rejected) and ``retry_after`` (the window, when rejected).

    ``limit`` is a number, or a number per action (the values of the last key;
    an action without one is an error). ``order_col`` breaks ties between requests at the same timestamp; rows
    whose first key column is null are admitted without state.
    """
    w_us = int(window_seconds) * _US
    cols = requests.columns
    user_null = F.col(keys[0]).isNull() if keys else F.lit(False)
    free = requests.filter(user_null).select(
        *cols, F.lit(True).alias("admitted"), F.lit(None).cast("bigint").alias("remaining"),
        F.lit(None).cast("bigint").alias("retry_after"))
    if not keys:
        raise ValueError("rate_limit needs at least one key column")
    knames = [f"_k{i}" for i in range(len(keys))]
    order = [F.col("_us")] + ([F.col(order_col)] if order_col else [])
    staged = (requests.filter(~user_null)
              .select(*cols, *[F.col(k).alias(n) for k, n in zip(keys, knames, strict=True)],
                      F.unix_micros(F.col(ts_col)).alias("_us"))
              .withColumn("_b", F.floor(F.col("_us") / w_us)))
    # the run of each row: one row per key and window-wide bucket, joined null-safe
    runs = bucket_sessions(requests.filter(~user_null), keys, ts_col, window_seconds).select(
        *[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], F.col("_b").alias("_rb"),
        F.col("session_start_us").alias(f"_k{len(keys)}"))
    same = F.col("_b") == F.col("_rb")
    for i in range(len(keys)):
        same = same & F.col(f"_k{i}").eqNullSafe(F.col(f"_r{i}"))
    knames.append(f"_k{len(keys)}")
    staged = staged.join(runs, same).select(*cols, *knames, "_us")
    staged = (staged.repartition(*[F.col(k) for k in knames])
              .sortWithinPartitions(*[F.col(k) for k in knames], *order))
    schema = T.StructType(list(requests.schema.fields) + [
        T.StructField("admitted", T.BooleanType()), T.StructField("_before", T.LongType())])
    flags = staged.mapInPandas(_scan(limit, w_us, len(knames)), schema)
    scanned = flags.select(
        *cols, "admitted",
        F.when(F.col("admitted"), limit_column(limit, keys) - F.col("_before") - 1).otherwise(F.lit(0))
        .cast("bigint").alias("remaining"),
        F.when(F.col("admitted"), F.lit(None)).otherwise(F.lit(window_seconds)).cast("bigint")
        .alias("retry_after"))
    return scanned.unionByName(free)


def first_requests(requests: DataFrame, keys: list[str]) -> DataFrame:
    """A20 input: per key how many requests there are and that the first of them is a
    miss, every later one a hit (a result that is kept for good)."""
    return requests.groupBy(*keys).agg(F.lit(1).cast("bigint").alias("misses"), (F.count(F.lit(1)) - 1).alias("hits"))


def hit_rate(counts: DataFrame) -> DataFrame:
    """Hits, misses, hit rate = hits/(hits+misses)*100 as 2-dp text, '0%' on zero."""
    agg = counts.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("misses"), F.lit(0)).alias("misses"))
    total = F.col("hits") + F.col("misses")
    from ..functions.text import fixed2
    rate = F.when(total == 0, F.lit("0%")).otherwise(
        F.concat(fixed2(F.col("hits").cast("double") / total * 100.0), F.lit("%")))
    return agg.select(F.col("hits").cast("bigint").alias("hits"), F.col("misses").cast("bigint").alias("misses"),
                      rate.alias("hit_rate"))
