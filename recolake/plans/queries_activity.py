"""Registered queries: activity counters, idle-TTL sessions, rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ts_text
from ..operators import activity as A
from ..operators import popular, ratelimit
from ..sources import tables as T
from .catalog import register
from .queries_inventory import F2

TS = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"

# fixed settings of the fixture runs
CATEGORY_TTL = 24 * 3600
USER_TTL = 24 * 3600
GLOBAL_TTL = 3600
SEARCH_TTL = 24 * 3600
LIMITS, HOUR = {"recommendations": 50, "search": 100}, 3600   # requests per user, action and hour
LIMIT, WINDOW = 2, 24 * 3600   # a limit tight enough that the fixtures' users meet it


def _sessions_sql(src: str, keys: list[str], ttl_s: int) -> str:
    """Per-row session start (micros) in SQL: lag over the key, break on gap > ttl."""
    part = f"partition by {', '.join(keys)} " if keys else ""
    ttl = ttl_s * 1_000_000
    return f"""
      (select *, max(brk) over ({part}order by us rows between unbounded preceding and current row) as sstart
       from (select *, case when lag(us) over ({part}order by us) is null
                             or us - lag(us) over ({part}order by us) > {ttl} then us end as brk
             from (select *, epoch_us(ts) as us from {src})))"""


@register("event_type_counts", "ST2", "select event_type, count(*) as n from v_activity group by event_type")
def q_event_type_counts(spark, d):
    return A.event_type_counts(T.activity(spark, d))


@register("hourly_event_counts", "ST2", f"""
    select {TS.format(c="date_trunc('hour', ts)")} as window_start, event_type, count(*) as n
    from v_activity group by 1, 2""")
def q_hourly(spark, d):
    h = A.hourly_event_counts(T.activity(spark, d))
    return h.select(ts_text("window_start").alias("window_start"), "event_type", "n")


def _category_views(spark, d):
    a = T.activity(spark, d, ("product_view",))
    i = T.products(spark, d).select("item_id", "main_category").filter(F.col("main_category").isNotNull())
    return a.join(i, "item_id")


@register("category_sessions", "ST4,W5,A13", f"""
    with v as (select i.main_category, a.item_id, a.ts from v_activity a join v_items i using (item_id)
               where a.event_type = 'product_view' and i.main_category is not null)
    select main_category, {TS.format(c='make_timestamp(sstart)')} as session_start, item_id, count(*) as n
    from {_sessions_sql('v', ['main_category'], CATEGORY_TTL)} s
    group by main_category, sstart, item_id""")
def q_category_sessions(spark, d):
    s = A.session_counts(_category_views(spark, d), ["main_category"], "item_id", "ts", CATEGORY_TTL)
    return s.select("main_category", ts_text("session_start").alias("session_start"), "item_id", "n")


@register("user_view_sessions", "ST5,W5,W3", f"""
    with v as (select event_id, user_id, item_id, ts from v_activity
               where event_type = 'product_view' and user_id is not null)
    select user_id, {TS.format(c='make_timestamp(sstart)')} as session_start, rank, event_id, item_id from
      (select *, row_number() over (partition by user_id, sstart order by us desc, event_id desc) as rank
       from {_sessions_sql('v', ['user_id'], USER_TTL)})
    where rank <= 100""")
def q_user_view_sessions(spark, d):
    v = T.activity(spark, d, ("product_view",)).filter(F.col("user_id").isNotNull())
    s = A.with_session(v, ["user_id"], "ts", USER_TTL)
    top = popular.top_k_per_key(s, ["user_id", "session_start"], [F.col("ts").desc(), F.col("event_id").desc()], 100)
    return top.select("user_id", ts_text("session_start").alias("session_start"), "rank", "event_id", "item_id")


@register("global_view_sessions", "ST6,W5,W4", f"""
    with v as (select event_id, user_id, item_id, ts from v_activity where event_type = 'product_view')
    select {TS.format(c='make_timestamp(sstart)')} as session_start, rank, event_id, item_id, user_id from
      (select *, row_number() over (partition by sstart order by us desc, event_id desc) as rank
       from {_sessions_sql('v', [], GLOBAL_TTL)})
    where rank <= 100""")
def q_global_view_sessions(spark, d):
    v = T.activity(spark, d, ("product_view",))
    s = A.with_session(v, [], "ts", GLOBAL_TTL)
    top = popular.top_k_per_key(s, ["session_start"], [F.col("ts").desc(), F.col("event_id").desc()], 100)
    return top.select(ts_text("session_start").alias("session_start"), "rank", "event_id", "item_id", "user_id")


@register("search_sessions", "ST7,W5,A14", f"""
    select {TS.format(c='make_timestamp(sstart)')} as session_start, query, count(*) as n
    from {_sessions_sql('v_search_log', [], SEARCH_TTL)} group by sstart, query""")
def q_search_sessions(spark, d):
    s = A.session_counts(T.search_log(spark, d), [], "query", "ts", SEARCH_TTL)
    return s.select(ts_text("session_start").alias("session_start"), "query", "n")


@register("search_popularity", "A14,T6", """
    select row_number() over (order by n desc, query) as rank, query, n from
      (select query, count(*) as n from v_search_log group by query)
    order by n desc, query limit 10""")
def q_search_popularity(spark, d):
    c = T.search_log(spark, d).groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    return popular.top_k(c, [F.col("n").desc(), F.col("query")], 10).select("rank", "query", "n")


@register("trailing_request_counts", "W6", f"""
    select event_id, user_id, action,
           count(*) over (partition by user_id, action order by epoch_us(ts)
                          range between {WINDOW * 1_000_000 - 1} preceding and current row) as trailing_count
    from v_requests""")
def q_trailing(spark, d):
    r = A.trailing_counts(T.requests(spark, d), ["user_id", "action"], "ts", WINDOW)
    return r.select("event_id", "user_id", "action", "trailing_count")


def _greedy_sql(src: str, keys: list[str], limit: int | dict, window_s: int) -> str:
    names = limit if isinstance(limit, dict) else {}
    of = (lambda t: f"(case {t}action " + " ".join(f"when '{a}' then {n}" for a, n in names.items()) + " end)"
          if names else str(limit))
    w = window_s * 1_000_000
    k = ", ".join(keys)
    on = " and ".join(f"r.{c} = s.{c}" for c in keys)
    kept = f"list_filter(s.state, lambda x: x > r.us - {w})"
    return f"""
    with recursive r as (select event_id, {k}, epoch_us(ts) as us,
                                row_number() over (partition by {k} order by ts, event_id) as rn
                         from {src} where {keys[0]} is not null),
    s as (select event_id, {k}, rn, true as admitted, 0::bigint as before, [us] as state from r where rn = 1
          union all
          select r.event_id, {', '.join('r.' + c for c in keys)}, r.rn,
                 len({kept}) < {of("r.")}, len({kept})::bigint,
                 case when len({kept}) < {of("r.")} then list_append({kept}, r.us) else {kept} end
          from s join r on {on} and r.rn = s.rn + 1)
    select event_id, {k}, admitted,
           case when admitted then {of("")} - before - 1 else 0 end::bigint as remaining,
           case when admitted then null else {window_s} end::bigint as retry_after
    from s"""


def _limited(spark, d, limit, window):
    r = ratelimit.rate_limit(T.requests(spark, d), ["user_id", "action"], "ts", limit, window, "event_id")
    return r.select("event_id", "user_id", "action", "admitted", "remaining", "retry_after")


@register("rate_limit_admission", "ST8,ST9", _greedy_sql("v_requests", ["user_id", "action"], LIMITS, HOUR))
def q_rate_limit(spark, d):
    return _limited(spark, d, LIMITS, HOUR)


@register("rate_limit_admission_tight", "ST8,ST9", _greedy_sql("v_requests", ["user_id", "action"], LIMIT, WINDOW))
def q_rate_limit_tight(spark, d):
    return _limited(spark, d, LIMIT, WINDOW)


@register("cache_hit_rate", "A20,F11", f"""
    with g as (select count(*) - count(distinct item_id) as hits, count(distinct item_id) as misses, count(*) as n
               from v_activity where event_type = 'product_view' and item_id is not null)
    select hits, misses, case when n = 0 then '0%'
           else {F2.format(v="cast(hits as double) / n * 100.0")} || '%' end as hit_rate from g""")
def q_cache_hit_rate(spark, d):
    v = T.activity(spark, d, ("product_view",)).filter(F.col("item_id").isNotNull())
    return ratelimit.hit_rate(ratelimit.first_requests(v, ["item_id"]))
