"""Registered queries run as Structured Streaming jobs (availableNow) from JSON text: the fixture events are written as lines in three
parts that arrive one after the other, some of them late, and the error events as text that is no JSON. Results are
compared with the same oracles as their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ts_text
from ..session import scratch_folder
from ..sources import tables as T
from ..streaming import activity as S
from . import queries_activity as QA
from .catalog import REGISTRY, register

PARTS, LATE_SECONDS, FILE_ROWS = 3, 86_400, 1_000_000
CUT = '{"event_id":'  # an error event's text: cut off after its id


def event_text(spark: SparkSession, d: str, late: bool = True) -> DataFrame:
    """The event table as a stream of JSON lines in three micro-batches by time; with ``late`` every fifth event of the last day of a part
    arrives with the next one."""
    e = T.read(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    low, high, n = e.agg(F.min("us"), F.max("us"), F.count(F.lit(1))).first()
    size = ((high or 0) - (low or 0)) // PARTS + 1
    part = F.floor((F.col("us") - F.lit(low or 0)) / size)
    moved = (F.col("event_id") % 5 == 0) & (F.pmod(F.col("us") - F.lit(low or 0), F.lit(size)) >= size - LATE_SECONDS * 1_000_000)
    part = F.least(part + F.when(moved & F.lit(late), 1).otherwise(0), F.lit(PARTS - 1))
    good = T.activity(spark, d).select(
        "event_id", "event_type", F.col("user_id").cast("string").alias("user_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.col("item_id").cast("string").alias("asin"), "ts")
    lines = S.to_event_json(good, ["ts"]).select("value", F.unix_micros("ts").alias("us"), "event_id")
    cut = e.filter("event_type = 'error'").select(F.concat(F.lit(CUT), F.col("event_id").cast("string"), F.lit(',"event_type":')).alias("value"), "us", "event_id")
    lines = lines.unionByName(cut).withColumn("part", part)
    path, files = scratch_folder(spark, "event-text"), max(1, -(-(n or 0) // (PARTS * FILE_ROWS)))
    for k in range(PARTS):
        lines.filter(F.col("part") == k).select("value").repartition(files).write.mode("append").text(path)
    return S.text_events(spark, path, files)


def _events(spark, d, late=True):
    """Typed events of the stream, in the shape of the activity table."""
    return S.typed_activity(S.parse_events(event_text(spark, d, late))[0])


@register("stream_event_type_counts", "ST1,ST2,S7,K8", REGISTRY["event_type_counts"].oracle)
def q_stream_event_counts(spark, d):
    return S.run_available_now(S.event_type_counts(_events(spark, d)), "event_type_counts", "complete")


@register("stream_ingested_events", "ST1,S7,K8", """
    select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, cast(user_id as varchar) as user_id, event_type, cast(item_id as varchar) as asin
    from v_activity""")
def q_stream_ingested(spark, d):
    path = scratch_folder(spark, "ingest")
    S.ingest(event_text(spark, d), path).awaitTermination()
    return S.ingested(spark, path)[0].select("event_id", ts_text("ts").alias("ts"), "user_id", "event_type", "asin")


@register("stream_rejected_events", "ST1,S7", f"""
    select '{CUT}' || event_id || ',"event_type":' as raw from events where event_type = 'error'""")
def q_stream_rejected(spark, d):
    path = scratch_folder(spark, "ingest")
    S.ingest(event_text(spark, d), path).awaitTermination()
    return S.ingested(spark, path)[1]


@register("stream_item_views", "ST3", REGISTRY["item_views"].oracle)
def q_stream_item_views(spark, d):
    return S.run_available_now(S.item_views(_events(spark, d)), "item_views", "complete")


@register("stream_category_sessions", "ST4,ST10", REGISTRY["category_sessions"].oracle)
def q_stream_category_sessions(spark, d):
    ev = _events(spark, d).filter(F.col("event_type") == "product_view")
    cats = T.products(spark, d).select("item_id", "main_category").filter(F.col("main_category").isNotNull())
    out = S.idle_reset_counters(ev.join(cats, "item_id"), "main_category", QA.CATEGORY_TTL, "category_counters")
    return out.select("main_category", ts_text("session_start").alias("session_start"), "item_id", "n")


@register("stream_user_view_sessions", "ST5,ST10", REGISTRY["user_view_sessions"].oracle)
def q_stream_user_views(spark, d):
    ev = _events(spark, d).filter(F.col("event_type") == "product_view")
    out = S.recent_lists(ev, "user_id", QA.USER_TTL, "user_recent", 100)
    return out.select("user_id", ts_text("session_start").alias("session_start"), "rank", "event_id", "item_id")


@register("stream_search_sessions", "ST7,A14,ST10", REGISTRY["search_sessions"].oracle)
def q_stream_search_sessions(spark, d):
    ev = _events(spark, d).filter(F.col("event_type") == "search")
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.lower("p_name").alias("query"))
    out = S.global_idle_reset_counts(ev.join(p, "item_id"), "query", QA.SEARCH_TTL, "search_sessions")
    return out.select(ts_text("session_start").alias("session_start"), "query", "n")


@register("stream_global_view_sessions", "ST6,W4,ST10", REGISTRY["global_view_sessions"].oracle)
def q_stream_global_views(spark, d):
    ev = _events(spark, d).filter(F.col("event_type") == "product_view").select("event_id", "user_id", "item_id", "ts")
    out = S.global_recent_list(ev, 100, QA.GLOBAL_TTL, "global_recent")
    return out.select(ts_text("session_start").alias("session_start"), "rank", "event_id", "item_id", "user_id")


GAP_SECONDS, WATERMARK_DAYS = 1800, 2


@register("stream_closed_sessions", "ST10,ST4", f"""
    with t as (select event_type, epoch_us(ts) as us from v_activity),
    marked as (select *, case when us - lag(us) over (partition by event_type order by us) < {GAP_SECONDS * 1_000_000} then 0 else 1 end as opens from t),
    numbered as (select *, sum(opens) over (partition by event_type order by us rows unbounded preceding) as k from marked),
    spans as (select event_type, min(us) as first_us, max(us) + {GAP_SECONDS * 1_000_000} as end_us, count(*) as n from numbered group by event_type, k)
    select event_type, strftime(make_timestamp(first_us), '%Y-%m-%d %H:%M:%S.%f') as session_start,
           strftime(make_timestamp(end_us), '%Y-%m-%d %H:%M:%S.%f') as session_end, n
    from spans where end_us <= (select max(us) from t) - {WATERMARK_DAYS * 86_400 * 1_000_000}""")
def q_stream_closed_sessions(spark, d):
    """Only sessions that the watermark has closed are emitted; late rows within it count."""
    out = S.run_available_now(S.session_totals(_events(spark, d), ["event_type"], f"{GAP_SECONDS} seconds", f"{WATERMARK_DAYS} days"),
                              "closed_sessions", "append")
    return out.select("event_type", ts_text("session_start").alias("session_start"), ts_text("session_end").alias("session_end"), "n")


def _stream_limited(spark, d, limit, window, name):
    # decisions follow the order of arrival, so this stream has no late events
    ev = _events(spark, d, late=False).filter(F.col("event_type").isin("search", "product_view"))
    action = F.when(F.col("event_type") == "search", "search").otherwise("recommendations")
    req = ev.select("event_id", "user_id", action.alias("action"), "ts")
    res = S.rate_limit_stream(req, ["user_id", "action"], limit, window)
    out = S.run_available_now(res, name, "append")
    return out.select("event_id", "user_id", "action", "admitted", "remaining", "retry_after")


@register("stream_rate_limit_admission", "ST8,ST9", REGISTRY["rate_limit_admission"].oracle)
def q_stream_rate_limit(spark, d):
    return _stream_limited(spark, d, QA.LIMITS, QA.HOUR, "rate_limit")


@register("stream_rate_limit_admission_tight", "ST8,ST9", REGISTRY["rate_limit_admission_tight"].oracle)
def q_stream_rate_limit_tight(spark, d):
    return _stream_limited(spark, d, QA.LIMIT, QA.WINDOW, "rate_limit_tight")
