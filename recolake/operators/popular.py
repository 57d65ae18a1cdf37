"""Popularity, history and list pages.

Top-k per key is written as ``row_number() <= k``: Spark plans a partial
``WindowGroupLimit`` before the shuffle, so a hot key is cut to k rows in
every map task instead of arriving whole at one reducer. Global top-k is
``orderBy().limit()`` = ``TakeOrderedAndProject`` (per-partition top-k, then
a k-row merge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def popularity_score(rating_number) -> Column:
    """rating_number / 1000 with a missing count as 0 (trap 22)."""
    c = F.col(rating_number) if isinstance(rating_number, str) else rating_number
    return F.coalesce(c, F.lit(0)).cast("double") / 1000.0


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int,
                  rank_col: str = "rank") -> DataFrame:
    """First k rows per key under ``order`` (must be a total order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w).cast("bigint"))
            .filter(F.col(rank_col) <= k))


def top_k(df: DataFrame, order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Global top-k with a rank column; the window runs over the k survivors only."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def popular_items(items: DataFrame, n: int = 10) -> DataFrame:
    """L1: most-rated items (missing counts last), score = rating_number / 1000."""
    order = [F.col("rating_number").desc_nulls_last(), F.col("item_id")]
    return top_k(items, order, n).select(
        "rank", "item_id", popularity_score("rating_number").alias("score"))


def category_hot_items(items: DataFrame, n: int = 5, category: str | None = None) -> DataFrame:
    """L2: per category (or one category) top-n by rating_number."""
    df = items.filter(F.col("main_category").isNotNull())
    if category is not None:
        df = df.filter(F.col("main_category") == category)
    order = [F.col("rating_number").desc_nulls_last(), F.col("item_id")]
    return top_k_per_key(df, ["main_category"], order, n).select(
        "main_category", "rank", "item_id", popularity_score("rating_number").alias("score"))


def ranked_list(df: DataFrame, n: int) -> Column:
    """A bounded ranked list (rank, item_id, score) as one array value, for
    attaching a fixed-size list to many rows without a join (uncorrelated
    scalar subquery; size is bounded by n)."""
    return (df.filter(F.col("rank") <= n)
            .agg(F.sort_array(F.collect_list(F.struct("rank", "item_id", "score"))))
            .scalar())


def user_history(ratings: DataFrame, n: int = 20) -> DataFrame:
    """L3 (bulk): each user's newest n ratings (ties: item, rating)."""
    order = [F.col("ts").desc(), F.col("item_id"), F.col("rating")]
    return top_k_per_key(ratings, ["user_id"], order, n)


def event_counts(activity: DataFrame, event_type: str, key: str = "item_id",
                 count_col: str = "n") -> DataFrame:
    """A12/ST3: count of one event type per key (partial + final aggregate)."""
    return (activity.filter((F.col("event_type") == event_type) & F.col(key).isNotNull())
            .groupBy(key).agg(F.count(F.lit(1)).alias(count_col)))


def trending(activity: DataFrame, n: int = 20, event_type: str = "product_view") -> DataFrame:
    """Top-n items by event count. Ties break by item id descending,
    like a sorted set read in reverse order."""
    c = event_counts(activity, event_type)
    return top_k(c, [F.col("n").desc(), F.col("item_id").desc()], n)


def enrich(ranked: DataFrame, items: DataFrame, how: str = "inner",
           cols: tuple[str, ...] = ("title", "main_category", "average_rating", "rating_number")) -> DataFrame:
    """J3 (inner: recs without product dropped) / J4 (left: raw rec kept).
    One equi join replaces per-item point lookups; AQE broadcasts the small side."""
    return ranked.join(items.select("item_id", *cols), "item_id", how)


def category_popular(activity: DataFrame, items: DataFrame, n: int = 20) -> DataFrame:
    """Per category top-n items by views (category from the product)."""
    views = event_counts(activity, "product_view")
    cat = views.join(items.select("item_id", "main_category"), "item_id")
    return top_k_per_key(cat.filter(F.col("main_category").isNotNull()), ["main_category"],
                         [F.col("n").desc(), F.col("item_id").desc()], n)


def recent_global(activity: DataFrame, n: int = 100, event_type: str = "product_view") -> DataFrame:
    """Newest n events of a type (TakeOrderedAndProject)."""
    v = activity.filter(F.col("event_type") == event_type)
    return top_k(v, [F.col("ts").desc(), F.col("event_id").desc()], n)


def recent_per_user(activity: DataFrame, n: int = 100, event_type: str = "product_view") -> DataFrame:
    """Each user's newest n events of a type."""
    v = activity.filter((F.col("event_type") == event_type) & F.col("user_id").isNotNull())
    return top_k_per_key(v, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], n)


def slice_list(ranked: DataFrame, num: int, rank_col: str = "rank") -> DataFrame:
    """First num entries of a longer ranked list."""
    return ranked.filter(F.col(rank_col) <= num)
