"""Activity-stream batch twins (W3-W6, A12-A14, ST2-ST7).

Idle-TTL sessions (a gap > TTL starts a new session, the reference's
EXPIRE-after-every-write counters) are computed without a per-key window over
raw rows, so one hot key never lands in one task:

* events are bucketed by ``floor(t / TTL)``; a gap > TTL can never occur
  inside a bucket, and an empty previous bucket always means a gap > TTL;
* the per-(key, bucket) min/max table is a partial aggregate (one row per
  key and TTL-wide bucket) - only this small table is ordered per key;
* breaks and session starts are derived on that table and joined back on
  (key, bucket); counts are pre-aggregated by (key, bucket, member) first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_US = 1_000_000


def bucket_sessions(df: DataFrame, keys: list[str], ts_col: str, ttl_seconds: int) -> DataFrame:
    """Per (keys, _b) bucket: the session start (micros) it belongs to."""
    ttl_us = int(ttl_seconds) * _US
    us = F.unix_micros(F.col(ts_col))
    b = df.select(*keys, us.alias("_us")).withColumn("_b", F.floor(F.col("_us") / ttl_us))
    bk = b.groupBy(*keys, "_b").agg(F.min("_us").alias("_bmin"), F.max("_us").alias("_bmax"))
    return sessions_of_buckets(bk, keys, ttl_seconds).drop("session_end_us")


def sessions_of_buckets(buckets: DataFrame, keys: list[str], ttl_seconds: int) -> DataFrame:
    """(keys, _b, session_start_us, session_end_us) from each bucket's first and last event (_bmin, _bmax)."""
    w = Window.partitionBy(*keys).orderBy("_b")
    prev_b, prev_max = F.lag("_b").over(w), F.lag("_bmax").over(w)
    next_b, next_min = F.lead("_b").over(w), F.lead("_bmin").over(w)
    ttl_us = int(ttl_seconds) * _US
    opens = prev_b.isNull() | (prev_b < F.col("_b") - 1) | (F.col("_bmin") - prev_max > ttl_us)
    closes = next_b.isNull() | (next_b > F.col("_b") + 1) | (next_min - F.col("_bmax") > ttl_us)
    marked = buckets.withColumns({"_start": F.when(opens, F.col("_bmin")), "_end": F.when(closes, F.col("_bmax"))})
    before, after = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return marked.select(*keys, "_b", F.max("_start").over(before).alias("session_start_us"), F.min("_end").over(after).alias("session_end_us"))


def with_session(df: DataFrame, keys: list[str], ts_col: str, ttl_seconds: int) -> DataFrame:
    """Every row with ``session_start`` (timestamp of the first event of its session)."""
    ttl_us = int(ttl_seconds) * _US
    rows = df.withColumn("_b", F.floor(F.unix_micros(F.col(ts_col)) / ttl_us))
    s = bucket_sessions(df, keys, ts_col, ttl_seconds)
    return (rows.join(s, [*keys, "_b"])
            .withColumn("session_start", F.timestamp_micros("session_start_us"))
            .drop("_b", "session_start_us"))


def session_counts(df: DataFrame, keys: list[str], member: str, ts_col: str,
                   ttl_seconds: int) -> DataFrame:
    """ST4/ST7: counters that reset after ``ttl_seconds`` idle per key:
    (keys, session_start, member, n). Rows are pre-aggregated per
    (key, bucket, member) before the join, so the join input is small."""
    ttl_us = int(ttl_seconds) * _US
    pre = (df.withColumn("_b", F.floor(F.unix_micros(F.col(ts_col)) / ttl_us))
           .groupBy(*keys, "_b", member).agg(F.count(F.lit(1)).alias("_n")))
    s = bucket_sessions(df, keys, ts_col, ttl_seconds)
    return (pre.join(s, [*keys, "_b"])
            .groupBy(*keys, "session_start_us", member).agg(F.sum("_n").alias("n"))
            .select(*keys, F.timestamp_micros("session_start_us").alias("session_start"), member,
                    F.col("n").cast("bigint").alias("n")))


def event_type_counts(activity: DataFrame) -> DataFrame:
    """ST2 (batch twin): events per type."""
    return activity.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def hourly_event_counts(activity: DataFrame, width: str = "1 hour") -> DataFrame:
    """ST2 report: tumbling-window counts per type."""
    return (activity.groupBy(F.window("ts", width).alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), "event_type", "n"))


def trailing_counts(df: DataFrame, keys: list[str], ts_col: str, window_seconds: int,
                    out: str = "trailing_count") -> DataFrame:
    """Per row, rows of the same key in (t - window, t] (ties at t included).

    Skew-proof formulation: count(t - w, t] = P(t) - P(t - w) where P is a
    running count in (key, time) order. Rows are first combined per (key, ts);
    every distinct (key, ts) also gets a probe at ts - w. One global prefix sum
    over (key, ts, row-before-probe) gives both values - range partitioning
    splits a hot key (or one burst) across tasks - and the counts are joined
    back on (key, ts).
    """
    w_us = int(window_seconds) * _US
    from .encode import prefix_sum
    pts = (df.select(*keys, F.unix_micros(F.col(ts_col)).alias("_us"))
           .groupBy(*keys, "_us").agg(F.count(F.lit(1)).cast("double").alias("_n")))
    rows = pts.select(*keys, "_us", "_n", F.lit(0).alias("_kind"), F.col("_us").alias("_t"))
    probes = pts.select(*keys, (F.col("_us") - w_us).alias("_us"), F.lit(0.0).alias("_n"),
                        F.lit(1).alias("_kind"), F.col("_us").alias("_t"))
    cum = prefix_sum(rows.unionByName(probes), [*[F.col(k) for k in keys], F.col("_us"), F.col("_kind")],
                     "_n", "_p")
    # both bounds of a window from one pass; a null key is a key of its own
    at = ["_t", *keys]
    bound = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_p")))
    both = cum.groupBy(*at).agg(F.round(bound(0) - bound(1)).cast("bigint").alias(out))
    counts = both.select(*[F.col(k).alias(f"_c_{k}") for k in at], out)
    rows = df.withColumn("_t", F.unix_micros(F.col(ts_col)))
    return rows.join(counts, _same(rows, counts, at, "_c_"), "left").select(*df.columns, out)


def _same(left: DataFrame, right: DataFrame, keys: list[str], prefix: str):
    """All keys equal, nulls included; the right side's keys carry the prefix."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[prefix + k])
    return cond
