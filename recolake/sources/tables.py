"""Canonical tables derived from the driver's parquet fixtures.

Every operator in the package works on these shapes (see FIXTURES.md):

* ``interactions(user_id, item_id, rating, ts)`` - one row per order line
* ``items(item_id, title, main_category, store, size, price, average_rating, rating_number)``
* ``item_vectors(item_id, model_factor)`` and the given factor tables
* ``activity(event_id, ts, user_id, event_type, item_id, value)`` - event log
* ``requests(user_id, action, ts)`` - rate-limit log
* ``key_inventory(db, key, type, size_bytes, ttl_s)`` - cache key inventory

All functions are lazy: they only declare plans, so Catalyst prunes columns
and pushes filters into the parquet scans of whatever the caller uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings 1..5 from order lines; user = customer, item = part."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("double").alias("rating"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )


def item_stats(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("item_id").agg(
        F.avg("rating").alias("average_rating"),
        F.count(F.lit(1)).alias("rating_number"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product attributes only (no rating statistics): what search, similarity
    and category lookups need - a plain scan, no aggregation of the fact."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"),
        F.col("p_type").alias("main_category"), F.col("p_brand").alias("store"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def items(spark: SparkSession, sf_dir: str, ratings: DataFrame | None = None) -> DataFrame:
    """Product table: part joined to its rating statistics (left: unrated parts keep nulls)."""
    ratings = ratings if ratings is not None else interactions(spark, sf_dir)
    return products(spark, sf_dir).join(item_stats(ratings), "item_id", "left")


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("model_factor"))


def user_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given user factors: embedding ``vec_id`` = customer key (users beyond the
    table's range have none, which is the 'known user without factor' class)."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("user_id"), F.col("embedding").alias("features"))


def item_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("features"))


EVENT_TYPE_MAP = {"view": "product_view", "click": "search", "signup": "user_registration"}


def activity(spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """Event log with the reference's event names; 'error' rows are not events.
    ``types`` (mapped names) is applied to the raw column, so it reaches the
    parquet scan as a pushed filter."""
    e = read(spark, sf_dir, "events")
    if types:
        raw = {v: k for k, v in EVENT_TYPE_MAP.items()}
        e = e.filter(F.col("event_type").isin([raw.get(t, t) for t in types]))
    return activity_from_events(e)


def activity_from_events(events: DataFrame) -> DataFrame:
    """Row mapping shared by the batch table and the event stream."""
    e = events.filter(F.col("event_type") != "error")
    et = F.col("event_type")
    mapped = (F.when(et == "view", "product_view").when(et == "click", "search")
              .when(et == "signup", "user_registration").otherwise(et))
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
        mapped.alias("event_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        "value")


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search events with their query text (the title of the searched item, lower case)."""
    a = activity(spark, sf_dir, ("search",))
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"),
                                           F.lower("p_name").alias("query"))
    return a.join(p, "item_id").select("event_id", "ts", "user_id", "query")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = activity(spark, sf_dir, ("search", "product_view"))
    action = F.when(F.col("event_type") == "search", "search").otherwise("recommendations")
    return a.select("event_id", "user_id", action.alias("action"), "ts")


def key_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache key inventory (db, key, type, size_bytes, ttl_s); ttl <= 0 = no expiry."""
    return read(spark, sf_dir, "events").select(*_key_columns())


def _key_columns() -> list:
    et, eid = F.col("event_type"), F.col("event_id")
    prefix = F.when(et == "view", "recs:").when(et == "click", "search:").otherwise("product:")
    suffix = F.when(et == "view", F.when(eid % 2 == 0, ":cf").otherwise(":hybrid")).otherwise("")
    return [
        F.concat(F.lit("db"), (eid % 2).cast("string")).alias("db"),
        F.concat(prefix, eid.cast("string"), suffix).alias("key"),
        F.when(et == "purchase", "zset").when(et == "error", "list").otherwise("string").alias("type"),
        F.floor(F.col("value") * 100).cast("bigint").alias("size_bytes"),
        (F.get_json_object("props", "$.k").cast("bigint") * 1200 - 1).alias("ttl_s")]


def keys_and_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event row as the key that it stands for and as an event (of no type and item where it is an error): one scan for reports on both."""
    et = F.col("event_type")
    mapped = et
    for raw, name in EVENT_TYPE_MAP.items():
        mapped = F.when(et == raw, name).otherwise(mapped)
    good = et != "error"
    return read(spark, sf_dir, "events").select(
        *_key_columns(), F.when(good, mapped).alias("event_type"), F.when(good, F.get_json_object("props", "$.k").cast("bigint")).alias("item_id"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query workload derived from the search events: the searched item's title
    (lower case), its category and its store - one row per distinct text."""
    a = activity(spark, sf_dir, ("search",)).select("item_id")
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_name", "p_type", "p_brand")
    j = a.join(p, "item_id")
    return (j.select(F.explode(F.array(F.lower("p_name"), "p_type", "p_brand")).alias("query"))
            .distinct())


def described_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with all searchable fields: the document of the same key is the description, the turns of the
    conversation of that key are the features (one text each, in order)."""
    text = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("description"))
    said = (read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("item_id"))
            .agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_t")).select("item_id", F.col("_t.text").alias("features")))
    return products(spark, sf_dir).join(text, "item_id", "left").join(said, "item_id", "left")


def text_search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``search_queries``, and the first two words of the searched items' descriptions."""
    a = activity(spark, sf_dir, ("search",)).select("item_id").distinct()
    text = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    words = F.array_join(F.slice(tokens("text"), 1, 2), " ")
    return search_queries(spark, sf_dir).union(a.join(text, "item_id").select(words).filter(words != "")).distinct()
