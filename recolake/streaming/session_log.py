"""Idle-TTL sessions over a stream as mergeable state (ST4-ST7, ST10).

State is kept per (key, time bucket of one TTL): counts per member or the newest rows, with the bucket's first and last event. A gap
longer than the TTL can neither lie inside a bucket nor be missed between two, so sessions follow from the buckets' (first, last) intervals
alone. Both are sums, minima and maxima: a micro-batch adds its own summary, whatever it holds - a late row falls into its bucket, extends a
session or joins two of them, exactly as if it had come in time.

* Epoch-numbered writes: epoch N is the folder ``delta/N``; a replayed epoch overwrites it, so it counts once.
* Found again on start: state is in the folder of the log alone, nothing in the driver; a restarted query goes on with it.
* No hot key: a batch is pre-aggregated where it lies; no task ever holds a key, only (key, bucket, member).
* Expiry: every ``compact_every`` epochs the deltas are folded into one table. With a ``lateness``, sessions that no accepted row can reach any
  more move to ``closed`` and leave the state; rows later than that are left out from then on (ST10). Without one all rows count for ever.

Defined results: rows without a timestamp are left out; a null key or member is a key or member; equal rows count each; an empty stream has no sessions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.activity import sessions_of_buckets
from ..operators.popular import top_k_per_key

_US = 1_000_000


@dataclass(frozen=True)
class SessionLog:
    """A log of sessions per ``keys``: counts per ``member``, or the ``newest`` rows (ordered by ts, then ``order_col``) with ``columns``."""
    path: str
    keys: list[str]
    ttl_seconds: int
    member: str | None = None
    newest: int | None = None
    columns: list[str] = field(default_factory=list)
    order_col: str = "event_id"
    lateness_seconds: int | None = None
    compact_every: int = 20

    # -- writing ------------------------------------------------------------------------------------------------------
    def _by_bucket(self) -> list[str]:
        return [*self.keys, "_b"]

    def _summary(self, rows: DataFrame) -> DataFrame:
        """Rows of one or more summaries, or fresh ones, as one summary."""
        if self.member is not None:
            return rows.groupBy(*self._by_bucket(), self.member).agg(
                F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
        # the oldest row of a bucket is kept besides the newest ones: it says where the bucket's interval begins
        top = top_k_per_key(rows.filter("not edge"), self._by_bucket(), [F.col("last_us").desc(), F.col(self.order_col).desc()], self.newest)
        low = top_k_per_key(rows, self._by_bucket(), [F.col("first_us"), F.col(self.order_col)], 1)
        return top.drop("rank").unionByName(low.drop("rank").withColumn("edge", F.lit(True)))

    def write(self, batch: DataFrame, epoch: int) -> None:
        """Add a micro-batch; the same epoch again replaces what it had added."""
        spark = batch.sparkSession
        if epoch and epoch % self.compact_every == 0:
            self.compact(spark, epoch - 1)
        us = F.unix_micros("ts")
        rows = batch.filter(F.col("ts").isNotNull()).withColumns({
            "_b": F.floor(us / (self.ttl_seconds * _US)), "n": F.lit(1).cast("long"), "first_us": us, "last_us": us, "edge": F.lit(False)})
        horizon = self._horizon(spark)
        if horizon is not None:
            rows = rows.filter(F.col("first_us") >= horizon)
        kept = [self.member, "n"] if self.member is not None else [*self.columns, "edge"]
        rows = rows.select(*dict.fromkeys([*self._by_bucket(), *kept, "first_us", "last_us"]))
        rows.persist()
        try:
            self._summary(rows).write.mode("overwrite").parquet(f"{self.path}/delta/{epoch}")
        finally:
            rows.unpersist()

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Run the stream into the log; with the same log it goes on where an earlier run ended."""
        return (stream.writeStream.foreachBatch(self.write).option("checkpointLocation", f"{self.path}/checkpoint")
                .trigger(**(trigger or {"availableNow": True})).start())

    # -- folders ------------------------------------------------------------------------------------------------------
    def _numbered(self, spark: SparkSession, kind: str) -> list[int]:
        """Completed numbered folders: one listing, a handful of names between two compactions."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder)
                      if s.getPath().getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def _state(self, spark: SparkSession, upto: int | None = None) -> DataFrame | None:
        """Everything that is not closed: the last compaction and the deltas after it."""
        bases = [b for b in self._numbered(spark, "base") if upto is None or b < upto]
        paths = [f"{self.path}/base/{bases[-1]}"] if bases else []
        paths += [f"{self.path}/delta/{d}" for d in self._numbered(spark, "delta") if d > (bases[-1] if bases else -1) and (upto is None or d <= upto)]
        return spark.read.parquet(*paths) if paths else None

    def _horizon(self, spark: SparkSession) -> int | None:
        found = self._numbered(spark, "horizon")
        return spark.read.parquet(f"{self.path}/horizon/{found[-1]}").first()[0] if found else None

    # -- reading ------------------------------------------------------------------------------------------------------
    def _with_sessions(self, state: DataFrame) -> DataFrame:
        spans = state.groupBy(*self._by_bucket()).agg(F.min("first_us").alias("_bmin"), F.max("last_us").alias("_bmax"))
        found = sessions_of_buckets(spans, self.keys, self.ttl_seconds)
        joined = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in self._by_bucket()]
        return state.alias("l").join(found.alias("r"), joined).select("l.*", "r.session_start_us", "r.session_end_us")

    def _result(self, rows: DataFrame) -> DataFrame:
        session = [*self.keys, "session_start_us", "session_end_us"]
        if self.member is not None:
            return rows.groupBy(*session, self.member).agg(F.sum("n").cast("long").alias("n"))
        order = [F.col("last_us").desc(), F.col(self.order_col).desc()]
        return top_k_per_key(rows.filter("not edge"), session, order, self.newest).drop("_b", "edge", "first_us")

    def sessions(self, spark: SparkSession) -> DataFrame | None:
        """All sessions, open and closed: the keys, session_start and (member, n) or (rank, columns); None before the first row."""
        state = self._state(spark)
        if state is None:
            return None
        found = self._result(self._with_sessions(state))
        for k in self._numbered(spark, "closed"):
            found = found.unionByName(spark.read.parquet(f"{self.path}/closed/{k}"))
        rest = [self.member, "n"] if self.member is not None else ["rank", *[c for c in self.columns if c not in self.keys]]
        return found.select(*self.keys, F.timestamp_micros("session_start_us").alias("session_start"), *rest)

    def compact(self, spark: SparkSession, epoch: int) -> None:
        """Fold everything up to an epoch into one table; sessions beyond the lateness are closed."""
        if epoch in self._numbered(spark, "base"):
            return
        state = self._state(spark, epoch)
        if state is None:
            return
        base = f"{self.path}/base/{epoch}"
        if self.lateness_seconds is None:
            self._summary(state).write.mode("overwrite").parquet(base)
            return
        last = state.agg(F.max("last_us")).first()[0]
        if last is None:
            self._summary(state).write.mode("overwrite").parquet(base)
            return
        horizon = last - self.lateness_seconds * _US
        rows = self._with_sessions(state)
        over = F.col("session_end_us") + self.ttl_seconds * _US < horizon
        self._result(rows.filter(over)).write.mode("overwrite").parquet(f"{self.path}/closed/{epoch}")
        spark.createDataFrame([(horizon,)], "horizon long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/horizon/{epoch}")
        # last: readers take the new base only when the closed sessions are there
        self._summary(rows.filter(~over).drop("session_start_us", "session_end_us")).write.mode("overwrite").parquet(base)
