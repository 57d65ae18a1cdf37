"""Cache-key inventory reports.

Input: a key inventory table ``(db, key, type, size_bytes, ttl_s)`` (ttl <= 0
= no expiry). Every report is a single aggregation pass (partial + final).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.text import format_bytes, glob_to_like, key_part
from ..session import scratch_folder
from .popular import top_k, top_k_per_key


def match(inv: DataFrame, pattern: str) -> DataFrame:
    """Keys matching a glob pattern (``recs:*``)."""
    return inv.filter(F.col("key").like(glob_to_like(pattern)))


def key_size_totals(inv: DataFrame, pattern: str = "*") -> DataFrame:
    """Total size and number of matching keys with a non-zero size."""
    m = match(inv, pattern).filter(F.coalesce("size_bytes", F.lit(0)) != 0)
    agg = m.agg(F.sum("size_bytes").cast("bigint").alias("total_bytes"),
                F.count(F.lit(1)).alias("total_keys"))
    return agg.select(F.lit(pattern).alias("pattern"), F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"),
                      format_bytes(F.coalesce("total_bytes", F.lit(0))).alias("total_size"), "total_keys")


def largest_keys(inv: DataFrame, pattern: str = "*", k: int = 10) -> DataFrame:
    """The k largest matching keys (ties by key)."""
    m = match(inv, pattern).filter(F.coalesce("size_bytes", F.lit(0)) != 0)
    return top_k(m, [F.col("size_bytes").desc(), F.col("key")], k).select(
        "rank", "key", "size_bytes", format_bytes("size_bytes").alias("size"))


def key_type_distribution(inv: DataFrame) -> DataFrame:
    """Keys per type plus the grand total (type null) via ROLLUP."""
    return inv.rollup("type").agg(F.count(F.lit(1)).alias("n"))


def expiry_buckets(inv: DataFrame) -> DataFrame:
    """Keys with a TTL, and those expiring within 1 h / 1 day (cumulative)."""
    t = F.col("ttl_s")
    return inv.agg(F.count_if(t > 0).alias("total_expiring"),
                   F.count_if((t > 0) & (t < 3600)).alias("expiring_within_1h"),
                   F.count_if((t > 0) & (t < 86400)).alias("expiring_within_1d"))


def recommendation_cache(inv: DataFrame, prefix: str = "recs") -> DataFrame:
    """Cached recommendation lists and distinct users (2nd key part)."""
    m = match(inv, f"{prefix}:*")
    return m.agg(F.count(F.lit(1)).alias("total_cached_recommendations"),
                 F.count_distinct(key_part("key", 1)).alias("users_with_cache"))


def search_cache(inv: DataFrame) -> DataFrame:
    """Cached searches (each key is one query)."""
    m = match(inv, "search:*")
    return m.agg(F.count(F.lit(1)).alias("total_cached_searches"),
                 F.count(F.lit(1)).alias("unique_queries"))


def keys_per_db(inv: DataFrame) -> DataFrame:
    """Keys, keys with expiry and mean TTL of expiring keys per db; db null = total."""
    t = F.col("ttl_s")
    return inv.rollup("db").agg(F.count(F.lit(1)).alias("keys"), F.count_if(t > 0).alias("expires"),
                                F.avg(F.when(t > 0, t)).alias("avg_ttl"))


def trending_totals(activity: DataFrame, cap: int = 100) -> DataFrame:
    """Number of viewed and of purchased items, each capped at the top ``cap``."""
    et = F.col("event_type")
    a = activity.filter(F.col("item_id").isNotNull() & et.isin("product_view", "purchase"))
    agg = a.agg(F.count_distinct(F.when(et == "product_view", F.col("item_id"))).alias("v"),
                F.count_distinct(F.when(et == "purchase", F.col("item_id"))).alias("p"))
    return agg.select(F.least("v", F.lit(cap)).cast("bigint").alias("total_viewed_products"),
                      F.least("p", F.lit(cap)).cast("bigint").alias("total_purchased_products"))


def report_log(inv: DataFrame, activity: DataFrame) -> DataFrame:
    """One log of key and event rows for ``inventory_report``, where they come from tables of their own."""
    return inv.unionByName(activity.select("event_type", "item_id"), allowMissingColumns=True)


def inventory_report(log: DataFrame, hit: DataFrame | None = None, top: int = 10, cap: int = 100) -> DataFrame:
    """Every report as one long table (section, metric, value), from one pass over a log of keys (db, key, type, size_bytes, ttl_s)
    and events (event_type, item_id); a row may be both, and the columns of what it is not are null.

    Every row becomes a few counted things (a type, a db, a user with cached recommendations, a viewed item ...). These are added up where they
    lie, so what is shuffled is a row per thing and task; the sections are then sums, counts and top lists over the things."""
    key, ttl = F.col("key"), F.col("ttl_s")
    is_key, size = key.isNotNull(), F.coalesce("size_bytes", F.lit(0))

    def thing(section: str, name, when, amount=None):
        return F.when(when, F.struct(F.lit(section).alias("section"), name.cast("string").alias("name"),
                                     (F.lit(0).cast("bigint") if amount is None else amount.cast("bigint")).alias("amount"), (ttl > 0).alias("expires")))
    item, kind = F.col("item_id"), F.col("event_type")
    things = F.array_compact(F.array(
        thing("db", F.col("db"), is_key, ttl), thing("type", F.col("type"), is_key),
        thing("bytes", F.lit("all"), is_key & (size != 0), size),
        thing("within", F.when(ttl < 3600, "1h").when(ttl < 86400, "1d").otherwise("later"), is_key & (ttl > 0)),
        thing("recs", F.split_part(key, F.lit(":"), F.lit(2)), key.startswith("recs:")), thing("search", F.lit("all"), key.startswith("search:")),
        thing("viewed", item, item.isNotNull() & (kind == "product_view")), thing("purchased", item, item.isNotNull() & (kind == "purchase"))))
    summed = (log.select(F.explode(things).alias("t")).groupBy("t.section", "t.name")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("t.amount").alias("amount"), F.count_if("t.expires").alias("expires"),
                   F.sum(F.when(F.col("t.expires"), F.col("t.amount"))).alias("ttl")))
    path = f"{scratch_folder(log.sparkSession, 'report')}/things"
    summed.write.parquet(path)
    summed = log.sparkSession.read.parquet(path)

    def of(section: str, value):
        return F.coalesce(F.sum(F.when(F.col("section") == section, value)), F.lit(0)).cast("bigint")

    def names(section: str):
        return F.count_if((F.col("section") == section) & F.col("name").isNotNull())
    n = F.col("n")
    totals = summed.agg(
        of("bytes", F.col("amount")).alias("b"), of("bytes", n).alias("k"), of("within", n).alias("e"),
        of("within", F.when(F.col("name") == "1h", n)).alias("h"), of("within", F.when(F.col("name") != "later", n)).alias("d"),
        of("recs", n).alias("r"), names("recs").alias("u"), of("search", n).alias("s"), names("viewed").alias("v"), names("purchased").alias("p"),
        names("type").alias("types"), of("type", n).alias("keys"), of("db", F.col("expires")).alias("x"), of("db", F.col("ttl")).alias("t"))
    mean = lambda t, x: F.floor(t / F.when(x > 0, x)).cast("bigint")
    fixed = [("key_sizes", "total_bytes", F.col("b")), ("key_sizes", "total_size", TX.format_bytes("b")), ("key_sizes", "total_keys", F.col("k")),
             ("expiry", "total_expiring", F.col("e")), ("expiry", "expiring_within_1h", F.col("h")), ("expiry", "expiring_within_1d", F.col("d")),
             ("recommendation_cache", "total_cached_recommendations", F.col("r")), ("recommendation_cache", "users_with_cache", F.col("u")),
             ("search_cache", "total_cached_searches", F.col("s")), ("search_cache", "unique_queries", F.col("s")),
             ("trending", "total_viewed_products", F.least("v", F.lit(cap))), ("trending", "total_purchased_products", F.least("p", F.lit(cap))),
             ("key_types", "type_count", F.col("types")), ("key_types", "total", F.col("keys")), ("keys_per_db", "total", F.col("keys")),
             ("expires_per_db", "total", F.col("x")), ("avg_ttl_per_db", "total", mean(F.col("t"), F.col("x")))]
    row = lambda section, metric, value: F.struct(F.lit(section).alias("section"), metric.alias("metric"), value.cast("string").alias("value"))
    out = totals.select(F.explode(F.array(*(row(a, F.lit(b), c) for a, b, c in fixed))).alias("r")).select("r.*")
    per = summed.filter("section in ('type', 'db') and name is not null").select(F.explode(F.when(F.col("section") == "type", F.array(
        row("key_types", F.col("name"), n))).otherwise(F.array(
            row("keys_per_db", F.col("name"), n), row("expires_per_db", F.col("name"), F.col("expires")),
            row("avg_ttl_per_db", F.col("name"), mean(F.col("ttl"), F.col("expires")))))).alias("r")).select("r.*")
    # ties by item id from the end, as a sorted set read in reverse order
    order = [n.desc(), F.col("name").try_cast("bigint").desc_nulls_last(), F.col("name").desc()]
    tops = top_k_per_key(summed.filter("section in ('viewed', 'purchased')"), ["section"], order, top).select(
        F.concat(F.lit("top_"), "section").alias("section"), F.col("name").alias("metric"), n.cast("string").alias("value"))
    out = out.unionByName(per).unionByName(tops)
    if hit is not None:
        out = out.unionByName(hit.select(F.explode(F.array(*(row("performance", F.lit(c), F.col(c)) for c in ("hits", "misses", "hit_rate")))).alias("r")).select("r.*"))
    return out
