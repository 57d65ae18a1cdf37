"""Hybrid recommendations for tables of users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cf import cf_lists, collaborative_recommendations, user_classes
from .similarity import BLOCK_ROWS
from .popular import category_hot_items, popular_items, ranked_list


def blend(cf_score, average_rating, cf_weight: float = 0.6, cb_weight: float = 0.4) -> Column:
    """F8: cf_weight * cf + cb_weight * avg/5, the boost only for a truthy rating."""
    avg = F.col(average_rating) if isinstance(average_rating, str) else average_rating
    cf = F.col(cf_score) if isinstance(cf_score, str) else cf_score
    boost = F.when(F.coalesce(avg, F.lit(0.0)) != 0, cb_weight * avg / 5.0).otherwise(F.lit(0.0))
    return cf_weight * cf + boost


def hybrid_recommendations(requests: DataFrame, user_dim: DataFrame, user_factors: DataFrame,
                           item_factors: DataFrame, items: DataFrame, num: int = 10,
                           cf_weight: float = 0.6, cb_weight: float = 0.4,
                           *, fallback_category: str, distinct_pad: bool = True,
                           block_size: int = BLOCK_ROWS) -> DataFrame:
    """R2 for every requested user: (user_id, rank, item_id, score, source).

    1. CF list of 2*num (popular list for users outside the dim, trap 5)
    2. inner join to products (missing product dropped), blend, top num
    3. short list -> pad with popular items ('popular_pad'); distinct by
       default, the reference's bag behaviour with ``distinct_pad=False``
    4. empty CF list (known user without factor) -> popular num//2 followed
       by the category's hot num//2 ('popular' / 'category_hot'), as coded

    Steps 2-3 are one aggregation per user over at most 2*num rows (a bounded
    list), so the CF kernel runs once and no per-user join is repeated.
    """
    # one row per requested user, used by three branches: materialised once (reliable checkpoint)
    cls = user_classes(requests, user_dim, user_factors).checkpoint(eager=True)
    cf2 = cf_lists(cls, user_factors, item_factors, items, 2 * num, block_size)
    prod = items.select("item_id", "average_rating", F.lit(True).alias("_has_product"))
    scored = (cf2.join(prod, "item_id", "left")
              .select("user_id", "item_id", "_has_product",
                      blend("score", "average_rating", cf_weight, cb_weight).alias("score")))
    entry = F.when(F.col("_has_product"), F.struct(
        (-F.round("score", 9)).alias("k"), F.col("item_id").alias("item_id"), F.col("score").alias("score")))
    # the pad pool is a bounded (2*num) scalar; attached as a column first because
    # higher-order functions cannot contain subqueries
    per_user = (scored.groupBy("user_id").agg(F.sort_array(F.collect_list(entry)).alias("_c"))
                .withColumn("_pool", ranked_list(popular_items(items, 2 * num), 2 * num)))
    best = F.slice("_c", 1, num)
    pool = F.col("_pool")
    need = F.lit(num) - F.size(best)
    if distinct_pad:
        pads = F.filter(pool, lambda p: ~F.array_contains(F.transform(best, lambda b: b["item_id"]),
                                                          p["item_id"]))
    else:
        pads = pool
    pads = F.slice(pads, 1, F.greatest(need, F.lit(0)))
    tagged = F.concat(
        F.transform(best, lambda b: F.struct(b["item_id"].alias("item_id"), b["score"].alias("score"),
                                             F.lit("hybrid").alias("source"))),
        F.transform(pads, lambda p: F.struct(p["item_id"].alias("item_id"), p["score"].alias("score"),
                                             F.lit("popular_pad").alias("source"))))
    lists = per_user.select("user_id", tagged.alias("_l"))
    listed = (lists.select("user_id", F.posexplode("_l").alias("_pos", "p"))
              .select("user_id", (F.col("_pos") + 1).cast("bigint").alias("rank"),
                      F.col("p.item_id").alias("item_id"), F.col("p.score").alias("score"),
                      F.col("p.source").alias("source")))

    # empty CF list: popular half + category-hot half (bag union, order kept)
    empty = cls.filter(F.col("known") & ~F.col("has_factor")).select("user_id")
    half = num // 2

    def as_list(df: DataFrame, source: str) -> Column:
        t = df.select(F.struct("rank", "item_id", "score", F.lit(source).alias("source")).alias("e"))
        return t.agg(F.sort_array(F.collect_list("e"))).scalar()

    mix = F.concat(as_list(popular_items(items, half), "popular"),
                   as_list(category_hot_items(items, half, fallback_category), "category_hot"))
    mixed = (empty.select("user_id", F.posexplode(F.slice(mix, 1, num)).alias("_pos", "p"))
             .select("user_id", (F.col("_pos") + 1).cast("bigint").alias("rank"),
                     F.col("p.item_id").alias("item_id"), F.col("p.score").alias("score"),
                     F.col("p.source").alias("source")))
    return listed.unionByName(mixed)


def recommend(requests: DataFrame, method: str, user_dim: DataFrame, user_factors: DataFrame,
              item_factors: DataFrame, items: DataFrame, num: int = 10, **kw) -> DataFrame:
    """Dispatch per method: 'hybrid', 'cf', anything else -> no rows."""
    if method == "hybrid":
        return hybrid_recommendations(requests, user_dim, user_factors, item_factors, items, num, **kw)
    if method == "cf":
        return collaborative_recommendations(requests, user_dim, user_factors, item_factors, items, num)
    # no rows, in the id types of the tables
    kinds = dict(requests.dtypes)["user_id"], dict(items.dtypes)["item_id"]
    return requests.sparkSession.createDataFrame(
        [], f"user_id {kinds[0]}, rank bigint, item_id {kinds[1]}, score double, source string")
