"""Structured Streaming versions of the activity state (S7, K8, ST1-ST10).

Sources: Kafka (``format('kafka')``, JSON values, ``startingOffsets=latest``)
on a cluster; the parquet file source in tests (the Kafka connector jar is
not on this image's classpath). Results are written by ``foreachBatch`` into
a parquet table under the session's checkpoint directory (never the driver's
memory), so a restarted query resumes from its checkpoint.

Idle-TTL state (ST4-ST7) is a ``session_log``: late rows join their session, a replayed epoch counts once, a restarted
query goes on. Late data (ST10): session windows take an event-time watermark (1 hour unless given); rows within it
are always counted, final sessions are emitted when it has passed. Rows older than the watermark may be
dropped (Spark's contract does not promise either way); complete mode keeps all state by definition.
"""

from __future__ import annotations

import os
import uuid
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, scratch_folder
from ..sources.tables import activity_from_events
from .session_log import SessionLog

# ST1: one nullable schema for the five event variants (ISO-8601 timestamp text)
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("asin", T.StringType()),
])

WATERMARK = "1 hour"


def parse_events(raw: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """ST1: JSON text -> typed events, plus the side output of unparsable rows (text that is no JSON object, or without an event type)."""
    parsed = raw.select(F.col(value_col).cast("string").alias("_raw"),
                        F.from_json(F.col(value_col).cast("string"), EVENT_SCHEMA).alias("e"))
    ok = F.col("e").isNotNull() & F.col("e.event_type").isNotNull()
    good = parsed.filter(ok).select("e.*").withColumn("ts", F.to_timestamp("timestamp"))
    bad = parsed.filter(~ok).select("_raw")
    return good, bad


def typed_activity(events: DataFrame) -> DataFrame:
    """Parsed events in the shape of the activity table: numeric user and item ids."""
    return events.select("event_id", "ts", F.col("user_id").try_cast("bigint").alias("user_id"), "event_type",
                         F.col("asin").try_cast("bigint").alias("item_id"))


def ingest(raw: DataFrame, path: str, value_col: str = "value", **trigger):
    """ST1: a stream of JSON text into two sinks, typed events and rejected rows. Both are folders of one write per epoch
    (``rejected=false`` and ``rejected=true``), which a replayed epoch overwrites; returns the running query."""
    def sink(batch: DataFrame, epoch: int) -> None:
        text = F.col(value_col).cast("string")
        e = F.from_json(text, EVENT_SCHEMA)
        rows = batch.select(text.alias("_raw"), e.alias("e")).withColumn("rejected", F.col("e").isNull() | F.col("e.event_type").isNull())
        rows = rows.select("rejected", F.when(F.col("rejected"), F.col("_raw")).alias("raw"),
                           *(F.when(~F.col("rejected"), F.col(f"e.{f.name}")).alias(f.name) for f in EVENT_SCHEMA.fields),
                           F.when(~F.col("rejected"), F.to_timestamp("e.timestamp")).alias("ts"))
        rows.write.mode("overwrite").partitionBy("rejected").parquet(f"{path}/epochs/epoch={epoch}")
    return (raw.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def ingested(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The typed events and the rejected texts that ``ingest`` wrote."""
    schema = T.StructType([T.StructField("epoch", T.LongType()), T.StructField("rejected", T.BooleanType()), T.StructField("raw", T.StringType()),
                           *EVENT_SCHEMA.fields, T.StructField("ts", T.TimestampType())])
    rows = spark.read.schema(schema).parquet(f"{path}/epochs")
    return rows.filter(~F.col("rejected")).drop("rejected", "raw", "epoch"), rows.filter("rejected").select("raw")


def text_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of JSON lines as a stream of raw values (the shape that the Kafka source has)."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def kafka_events(spark: SparkSession, servers: str, topic: str = "recommendation_events") -> DataFrame:
    """The event topic as a stream of raw JSON values."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", "latest").load())


def to_event_json(events: DataFrame, beside: list[str] | None = None) -> DataFrame:
    """K8: events as JSON values for a Kafka (or any text) sink: the columns of the event schema, with the events' other columns ``beside``."""
    own = [f.name for f in EVENT_SCHEMA.fields if f.name in events.columns]
    extra = [c for c in beside or [] if c not in own] + [c for c in ("event_id",) if beside and c in own]
    return events.select(F.to_json(F.struct(*own)).alias("value"), *extra)


def file_events(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """The fixture ``events`` parquet as a stream, mapped to the activity shape."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    # a table is a folder of part files, or one file in the folder of all tables
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return activity_from_events(reader.parquet(f"{sf_dir}/events.parquet"))
    return activity_from_events(reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def event_type_counts(events: DataFrame) -> DataFrame:
    """ST2: running count per event type (complete/update mode)."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def item_views(events: DataFrame) -> DataFrame:
    """ST3: running views per item."""
    return (events.filter((F.col("event_type") == "product_view") & F.col("item_id").isNotNull())
            .groupBy("item_id").agg(F.count(F.lit(1)).alias("n")))


def session_totals(events: DataFrame, keys: list[str], gap: str, watermark: str = WATERMARK) -> DataFrame:
    """ST4/ST7 (stream): idle-TTL sessions per key with their event counts, via
    session windows (a gap equal to ``gap`` still merges, like the batch twin's
    'gap > TTL'). Session windows are formed per grouping key, so the per-member
    counters inside one key's session are produced by the batch twin
    (``operators.activity.session_counts``), not here."""
    w = events.withWatermark("ts", watermark)
    return (w.groupBy(*keys, F.session_window("ts", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n"))


BUCKETS = 1024  # of keys; a bucket's state is one row, and one call of Python takes all of its requests of a micro-batch


def _plain(values: pd.Series) -> list:
    return [None if v is None or v != v else v for v in values.tolist()]


def _rate_state_fn(keys: list[str], limits: int | dict, window_us: int, order_col: str):
    def fn(key, pdfs, state):
        now = state.getCurrentWatermarkMs()
        held: dict[tuple, deque] = {}
        if state.exists:
            *own, sizes, stamps = state.get
            at = 0
            for k, n in zip(zip(*own, strict=True), sizes, strict=True):
                held[k] = deque(stamps[at:at + n])
                at += n
        out = None
        if not state.hasTimedOut:
            rows = pd.concat(list(pdfs), ignore_index=True)
            rows["_us"] = rows["ts"].astype("int64") // 1000  # ns -> micros
            rows = rows.sort_values(["_us", order_col], kind="stable", ignore_index=True)
            ok, rem = [], []
            for k, t in zip(zip(*(_plain(rows[c]) for c in keys), strict=True), rows["_us"].tolist(), strict=True):
                if k[0] is None:  # no user: never limited, no state
                    ok.append(True)
                    rem.append(None)
                    continue
                limit = limits[k[-1]] if isinstance(limits, dict) else limits
                admitted = held.get(k)
                if admitted is None:
                    admitted = held[k] = deque()
                while admitted and admitted[0] <= t - window_us:
                    admitted.popleft()
                if len(admitted) < limit:
                    admitted.append(t)
                    ok.append(True)
                    rem.append(limit - len(admitted))
                else:
                    ok.append(False)
                    rem.append(0)
            out = rows.drop(columns=["_us", "_bucket"]).assign(admitted=ok, remaining=pd.array(rem, dtype="Int64"))
        # a key goes when every request that it was admitted has left the window
        ends = {k: (v[-1] + window_us) // 1000 + 1 for k, v in held.items() if v}
        left = {k: held[k] for k, end in ends.items() if end > now}
        if left:
            state.update((*(list(c) for c in zip(*left, strict=True)), [len(v) for v in left.values()], [t for v in left.values() for t in v]))
            state.setTimeoutTimestamp(max(ends.values()))
        elif state.exists:
            state.remove()
        if out is not None:
            yield out
    return fn


def rate_limit_stream(requests: DataFrame, keys: list[str], limit: int | dict, window_seconds: int,
                      order_col: str = "event_id", watermark: str = WATERMARK, buckets: int = BUCKETS) -> DataFrame:
    """ST8/ST9 as keyed state: per key (the user first, the action last) the admitted timestamps still in the window (at most ``limit`` values).
    Within a micro-batch a key's requests are admitted in event-time order. A key's state goes when the watermark has passed
    its window; requests older than the watermark may be dropped. Requests without a user have no state and are spread over tasks.

    Keys are dealt by hash into ``buckets`` whose state is one row, as a call of Python for every key costs far more than its requests;
    a bucket's requests of one micro-batch are in memory at once. The number of buckets is fixed for the life of a checkpoint."""
    cols = requests.columns
    out_schema = T.StructType(list(requests.schema.fields) + [
        T.StructField("admitted", T.BooleanType()), T.StructField("remaining", T.LongType())])
    state_schema = T.StructType([T.StructField(k, T.ArrayType(requests.schema[k].dataType)) for k in keys] + [
        T.StructField("_sizes", T.ArrayType(T.LongType())), T.StructField("_stamps", T.ArrayType(T.LongType()))])
    fn = _rate_state_fn(keys, limit, int(window_seconds) * 1_000_000, order_col)
    dealt = F.when(F.col(keys[0]).isNull(), F.xxhash64(order_col)).otherwise(F.xxhash64(*keys))
    # in a bucket a key column is null everywhere or nowhere: pandas would make floats of a mixture
    nulls = sum((F.col(k).isNull().cast("int") * 2 ** i for i, k in enumerate(keys)), F.lit(0))
    res = (requests.withWatermark("ts", watermark).withColumn("_bucket", nulls * buckets + F.pmod(dealt, F.lit(buckets))).groupBy("_bucket")
           .applyInPandasWithState(fn, out_schema, state_schema, "append", "EventTimeTimeout"))
    retry = F.when(F.col("admitted"), F.lit(None)).otherwise(F.lit(window_seconds)).cast("bigint")
    return res.select(*cols, "admitted", "remaining", retry.alias("retry_after"))


def _run(stream: DataFrame, log: SessionLog, columns: str) -> DataFrame:
    log.start(stream).awaitTermination()
    found = log.sessions(stream.sparkSession)
    return stream.sparkSession.createDataFrame([], columns) if found is None else found


def _log(stream: DataFrame, name: str, path: str | None, keys: list[str], ttl_seconds: int, **more) -> SessionLog:
    return SessionLog(path or scratch_folder(stream.sparkSession, f"streams/{name}"), keys, ttl_seconds, **more)


def _kinds(stream: DataFrame, columns: list[str]) -> str:
    return "".join(f"{c} {dict(stream.dtypes)[c]}, " for c in columns)


def idle_reset_counters(stream: DataFrame, key: str, ttl_seconds: int, name: str, path: str | None = None, **more) -> DataFrame:
    """ST4: per ``key`` (category) item counters that reset after ``ttl_seconds`` without events: (key, session_start, item_id, n) of all
    that is available. State is per (key, bucket, item). ``path`` names a standing log that later runs go on with."""
    rows = stream.filter(F.col("item_id").isNotNull())
    return _run(rows, _log(stream, name, path, [key], ttl_seconds, member="item_id", **more),
                _kinds(stream, [key]) + "session_start timestamp, " + _kinds(stream, ["item_id"]) + "n bigint")


def recent_lists(stream: DataFrame, key: str, ttl_seconds: int, name: str, n: int = 100, path: str | None = None, **more) -> DataFrame:
    """ST5: per key (user) the newest ``n`` events of each session: (key, session_start, rank, event_id, item_id); a key that is null has none."""
    columns = ["event_id", "item_id"]
    return _run(stream.filter(F.col(key).isNotNull()), _log(stream, name, path, [key], ttl_seconds, newest=n, columns=columns, **more),
                _kinds(stream, [key]) + "session_start timestamp, rank bigint, " + _kinds(stream, columns)[:-2])


def global_idle_reset_counts(stream: DataFrame, member: str, ttl_seconds: int, name: str, path: str | None = None, **more) -> DataFrame:
    """ST7: one global counter set (search popularity) that resets after ``ttl_seconds`` idle: (session_start, member, n)."""
    return _run(stream, _log(stream, name, path, [], ttl_seconds, member=member, **more),
                "session_start timestamp, " + _kinds(stream, [member]) + "n bigint")


def global_recent_list(stream: DataFrame, n: int, ttl_seconds: int, name: str, order_col: str = "event_id", path: str | None = None, **more) -> DataFrame:
    """ST6: one global list of the newest ``n`` events that resets after ``ttl_seconds`` idle: (session_start, rank, the columns)."""
    columns = [c for c in stream.columns if c != "ts"] + ["ts"]
    return _run(stream, _log(stream, name, path, [], ttl_seconds, newest=n, columns=columns, order_col=order_col, **more),
                "session_start timestamp, rank bigint, " + _kinds(stream, columns)[:-2])


def run_available_now(stream: DataFrame, name: str, mode: str = "complete",
                      keys: list[str] | None = None) -> DataFrame:
    """Run a streaming query over everything available, then return its result
    table (parquet under the checkpoint directory). complete: each batch
    overwrites; append: batches append; update: batches append with their
    epoch and the latest row per ``keys`` wins when read."""
    spark = stream.sparkSession
    base = os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")
    out = os.path.join(base, "table")

    def sink(batch: DataFrame, epoch: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out)
        elif mode == "update":
            batch.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(out)
        else:
            batch.write.mode("append").parquet(out)

    q = (stream.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", os.path.join(base, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(out)
    if mode == "update":
        vals = [c for c in res.columns if c not in (keys or []) and c != "_epoch"]
        latest = res.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col("_epoch")).alias("_v"))
        res = latest.select(*keys, "_v.*")
    return res
