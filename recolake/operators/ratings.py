"""Rating preparation and rating reports.

All aggregations are hash aggregates with a map-side partial step, so a hot
(user, item) pair or a hot rating value is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in ``subset`` (all columns when None)."""
    return df.na.drop(subset=subset)


def prepare_ratings_first(reviews: DataFrame, user_col: str = "user_id", item_col: str = "item_id",
                          rating_col: str = "rating", ts_col: str = "ts",
                          compat: bool = False) -> DataFrame:
    """M1: one rating per (item, user).

    Default contract: rows without item, user or rating are dropped first (a rating
    without a timestamp stays; any dated one is newer), then the newest row is kept
    (ties: higher rating). ``compat=True`` keeps the reference's order (de-dup
    first, then null drop), where a null duplicate can erase a valid rating.
    The keep-newest step is ``max(struct(ts, rating))`` per key - a partial
    aggregate, so one hot pair never lands whole in one task.
    """
    cols = [F.col(item_col), F.col(user_col), F.col(rating_col), F.col(ts_col)]
    df = reviews.select(*cols)
    if not compat:
        df = df.na.drop(subset=[item_col, user_col, rating_col])
    newest = df.groupBy(item_col, user_col).agg(
        F.max(F.struct(F.col(ts_col).alias("t"), F.col(rating_col).alias("r"))).alias("_m"))
    out = newest.select(item_col, user_col, F.col("_m.r").alias(rating_col), F.col("_m.t").alias(ts_col))
    return out.na.drop(subset=[item_col, user_col, rating_col]) if compat else out


def prepare_ratings_mean(reviews: DataFrame, user_col: str = "user_id", item_col: str = "item_id",
                         rating_col: str = "rating", ts_col: str = "ts") -> DataFrame:
    """M2/A1: drop nulls in the key columns, cast, average duplicates, keep latest time."""
    df = (reviews.select(user_col, item_col, rating_col, ts_col)
          .na.drop(subset=[user_col, item_col, rating_col])
          .withColumn(rating_col, F.col(rating_col).cast("double")))
    return df.groupBy(user_col, item_col).agg(
        F.avg(rating_col).alias(rating_col), F.max(ts_col).alias("latest_ts"))


def rating_distribution(ratings: DataFrame, rating_col: str = "rating") -> DataFrame:
    """A4: count per rating value, most frequent first."""
    return (ratings.groupBy(rating_col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.col(rating_col)))


def rating_stats(ratings: DataFrame, rating_col: str = "rating") -> DataFrame:
    """A5 + A11: exact quartiles, IQR, mean, sample std-dev and count in one pass.

    ``percentile`` keeps a value->count map per partial aggregate, so its
    memory grows with distinct values (5 for ratings), not with rows.
    """
    r = F.col(rating_col).cast("double")
    q = F.percentile(r, [0.25, 0.5, 0.75])
    return (ratings.agg(q.alias("_q"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("stddev"),
                        F.count(r).alias("n"))
            .select(F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                    F.col("_q")[2].alias("q3"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"),
                    "mean", "stddev", "n"))


def equal_width_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin 1..bins over [lo, hi], last bin closed; lo == hi widens to +-0.5."""
    lo2 = F.when(lo == hi, lo - 0.5).otherwise(lo)
    hi2 = F.when(lo == hi, hi + 0.5).otherwise(hi)
    b = F.floor((x - lo2) * bins / (hi2 - lo2)) + 1
    return F.least(b, F.lit(bins).cast("bigint"))


def rating_histogram(ratings: DataFrame, rating_col: str = "rating", bins: int = 10) -> DataFrame:
    """A10: histogram like ``plt.hist(bins=10)``, empty bins included.

    Min and max are fetched first (one aggregate job, two numbers), so no cross
    join and no single-partition window is needed.
    """
    r = F.col(rating_col).cast("double")
    vals = ratings.select(r.alias("x")).filter(F.col("x").isNotNull())
    lo_v, hi_v = vals.agg(F.min("x"), F.max("x")).first()  # two numbers, one pass
    mn, mx = F.lit(lo_v).cast("double"), F.lit(hi_v).cast("double")
    lo = F.when(mn == mx, mn - 0.5).otherwise(mn)
    hi = F.when(mn == mx, mx + 0.5).otherwise(mx)
    counts = (vals.select(equal_width_bin(F.col("x"), mn, mx, bins).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    spark = ratings.sparkSession
    domain = spark.range(1, bins + 1).select(F.col("id").alias("bin"))
    width = (hi - lo) / bins
    return (domain.join(counts, "bin", "left")
            .select("bin", (lo + (F.col("bin") - 1) * width).alias("lo"),
                    (lo + F.col("bin") * width).alias("hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def pair_fact(reviews: DataFrame, user_col: str = "user_id", item_col: str = "item_id", rating_col: str = "rating",
              ts_col: str = "ts") -> DataFrame:
    """One row per (user, item), nulls included: ``n`` rows, ``n_rated`` with all three of user, item and rating, and the ``newest`` of those
    as (ts, rating). Written once, it holds what the rating table, both label indexes and the stage counts need."""
    complete = F.col(user_col).isNotNull() & F.col(item_col).isNotNull() & F.col(rating_col).isNotNull()
    return reviews.groupBy(user_col, item_col).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(complete).alias("n_rated"),
        F.max(F.when(complete, F.struct(F.col(ts_col).alias("ts"), F.col(rating_col).alias("rating")))).alias("newest"))


def newest_of(pairs: DataFrame, user_col: str = "user_id", item_col: str = "item_id") -> DataFrame:
    """M1 from the fact of pairs: (item, user, rating, ts)."""
    return pairs.filter("newest is not null").select(item_col, user_col, "newest.rating", "newest.ts")


def stage_counts(reviews: DataFrame, user_col: str = "user_id", item_col: str = "item_id",
                 rating_col: str = "rating") -> DataFrame:
    """Rows at each preparation stage in one pass: raw, complete, distinct pairs, users and items. Rows are combined by
    pair first; the distinct counts then run over pairs."""
    complete = F.col(user_col).isNotNull() & F.col(item_col).isNotNull() & F.col(rating_col).isNotNull()
    pairs = reviews.groupBy(user_col, item_col).agg(F.count(F.lit(1)).alias("n"), F.count_if(complete).alias("c"))
    rated = F.col("c") > 0
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_rows"), F.coalesce(F.sum("c"), F.lit(0)).alias("complete_rows"),
        F.count_if(rated).alias("distinct_pairs"), F.count_distinct(F.when(rated, F.col(user_col))).alias("distinct_users"),
        F.count_distinct(F.when(rated, F.col(item_col))).alias("distinct_items"))


def top_categories(items: DataFrame, category_col: str = "main_category", k: int = 10) -> DataFrame:
    """A8 + A9: top-k categories by product count (null category dropped) and the
    share of each within the top k (one-decimal percent, as the pie shows it)."""
    top = (items.filter(F.col(category_col).isNotNull())
           .groupBy(category_col).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), F.col(category_col)).limit(k))
    total = F.sum("n").over(_whole())
    return top.select(
        F.col(category_col).alias("category"), "n",
        F.round(F.col("n") * 100.0 / total, 1).alias("share_of_top"))


def _whole():
    from pyspark.sql import Window
    return Window.partitionBy()


def key_hash(df: DataFrame, key_cols: list[str], seed: int = 42) -> Column:
    """A hash of the key that any engine has: the MD5 (hex) of seed and key values as text, timestamps as microseconds, nulls empty."""
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        v = F.unix_micros(c) if kinds[c] == "timestamp" else F.col(c)
        return F.coalesce(v.cast("string"), F.lit(""))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(text(c) for c in key_cols)).cast("binary"))


def split_share(df: DataFrame, key_cols: list[str], seed: int = 42) -> Column:
    """Where a key falls in [0, 10000): the first eight hex digits of its hash, modulo."""
    return F.conv(F.substring(key_hash(df, key_cols, seed), 1, 8), 16, 10).cast("bigint") % 10000


def hash_split(df: DataFrame, key_cols: list[str], train_fraction: float = 0.8,
               seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M4: deterministic split by a hash of the key; stable under re-partitioning
    and re-execution, unlike ``randomSplit`` over an uncached source."""
    cut = int(round(train_fraction * 10000))
    tagged = df.withColumn("_h", split_share(df, key_cols, seed))
    return (tagged.filter(F.col("_h") < cut).drop("_h"),
            tagged.filter(F.col("_h") >= cut).drop("_h"))


def hash_sample(df: DataFrame, key_cols: list[str], n: int, seed: int = 42) -> DataFrame:
    """Fixed-size deterministic sample: the n rows with the smallest keyed hash, equal keys by all columns. The bottom n of a union are the
    bottom n of the parts' bottom n, so it is planned as TakeOrderedAndProject: a top-n in every task, then a merge."""
    return df.withColumn("_h", key_hash(df, key_cols, seed)).orderBy("_h", *key_cols, *[c for c in df.columns if c not in key_cols]).limit(n).drop("_h")
