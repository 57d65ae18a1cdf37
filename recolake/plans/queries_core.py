"""Registered queries: rating preparation, indexing and rating reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ts_text
from ..operators import encode, ratings
from ..session import scratch_folder
from ..sources import tables as T
from .catalog import register


@register("ratings_newest_per_pair", "M1,P1,P3,A2", """
    select item_id, user_id, rating, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts
    from (select *, row_number() over (partition by item_id, user_id order by ts desc, rating desc) as rn
          from v_interactions
          where user_id is not null and item_id is not null and rating is not null and ts is not null)
    where rn = 1""")
def q_ratings_newest(spark, d):
    r = ratings.prepare_ratings_first(T.interactions(spark, d))
    return r.select("item_id", "user_id", "rating", ts_text("ts").alias("ts"))


@register("ratings_mean_per_pair", "M2,P2,P4,F1,A1", """
    select user_id, item_id, avg(cast(rating as double)) as rating,
           strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as latest_ts
    from v_interactions
    where user_id is not null and item_id is not null and rating is not null
    group by user_id, item_id""")
def q_ratings_mean(spark, d):
    r = ratings.prepare_ratings_mean(T.interactions(spark, d))
    return r.select("user_id", "item_id", "rating", ts_text("latest_ts").alias("latest_ts"))


@register("rating_distribution", "A4", """
    select rating, count(*) as n from v_interactions group by rating""")
def q_rating_distribution(spark, d):
    return ratings.rating_distribution(T.interactions(spark, d))


@register("rating_stats", "A5,A11,M7", """
    select quantile_cont(rating, 0.25) as q1, quantile_cont(rating, 0.5) as median,
           quantile_cont(rating, 0.75) as q3,
           quantile_cont(rating, 0.75) - quantile_cont(rating, 0.25) as iqr,
           avg(rating) as mean, stddev_samp(rating) as stddev, count(rating) as n
    from v_interactions""")
def q_rating_stats(spark, d):
    return ratings.rating_stats(T.interactions(spark, d))


@register("rating_histogram", "A10", """
    with v as (select rating as x from v_interactions where rating is not null),
         b as (select min(x) as mn, max(x) as mx from v),
         lh as (select case when mn = mx then mn - 0.5 else mn end as lo,
                       case when mn = mx then mx + 0.5 else mx end as hi from b),
         c as (select least(cast(floor((x - lo) * 10 / (hi - lo)) as bigint) + 1, 10) as bin, count(*) as n
               from v, lh group by 1)
    select g.bin, lo + (g.bin - 1) * ((hi - lo) / 10) as lo, lo + g.bin * ((hi - lo) / 10) as hi,
           cast(coalesce(c.n, 0) as bigint) as n
    from (select cast(range as bigint) as bin from range(1, 11)) g cross join lh
         left join c on g.bin = c.bin""")
def q_rating_histogram(spark, d):
    return ratings.rating_histogram(T.interactions(spark, d))


@register("stage_counts", "A6", """
    select (select count(*) from v_interactions) as raw_rows,
           (select count(*) from v_interactions where user_id is not null and item_id is not null
                   and rating is not null) as complete_rows,
           (select count(*) from (select distinct user_id, item_id from v_interactions
                   where user_id is not null and item_id is not null and rating is not null)) as distinct_pairs,
           (select count(distinct user_id) from v_interactions where user_id is not null
                   and item_id is not null and rating is not null) as distinct_users,
           (select count(distinct item_id) from v_interactions where user_id is not null
                   and item_id is not null and rating is not null) as distinct_items""")
def q_stage_counts(spark, d):
    return ratings.stage_counts(T.interactions(spark, d))


@register("user_index", "A23,K5", """
    select user_id, count(*) as n,
           row_number() over (order by count(*) desc, user_id) - 1 as idx
    from v_interactions where user_id is not null group by user_id""")
def q_user_index(spark, d):
    return encode.dense_index(T.interactions(spark, d).select("user_id"), "user_id")


@register("item_index", "A23,K5", """
    select item_id, count(*) as n,
           row_number() over (order by count(*) desc, item_id) - 1 as idx
    from v_interactions where item_id is not null group by item_id""")
def q_item_index(spark, d):
    return encode.dense_index(T.interactions(spark, d).select("item_id"), "item_id")


@register("encoded_ratings", "M3,A23,J8", """
    with r as (select item_id, user_id, rating from
                 (select *, row_number() over (partition by item_id, user_id order by ts desc, rating desc) rn
                  from v_interactions) where rn = 1),
         u as (select user_id, row_number() over (order by count(*) desc, user_id) - 1 as user_idx
               from v_interactions group by user_id),
         i as (select item_id, row_number() over (order by count(*) desc, item_id) - 1 as item_idx
               from v_interactions group by item_id)
    select r.user_id, r.item_id, r.rating, u.user_idx, i.item_idx
    from r join u using (user_id) join i using (item_id)""")
def q_encoded_ratings(spark, d):
    path = f"{scratch_folder(spark, 'pairs')}/fact"
    ratings.pair_fact(T.interactions(spark, d)).write.parquet(path)
    pairs = spark.read.parquet(path)
    udim = encode.dense_index(pairs.select("user_id", "n"), "user_id", weight_col="n")
    idim = encode.dense_index(pairs.select("item_id", "n"), "item_id", weight_col="n")
    return encode.encode_ratings(ratings.newest_of(pairs), udim, idim).select("user_id", "item_id", "rating", "user_idx", "item_idx")


@register("training_users_first", "L10,M11,K11,L9", """
    select user_id, idx from
      (select user_id, row_number() over (order by count(*) desc, user_id) - 1 as idx
       from v_interactions group by user_id)
    where idx < 100""")
def q_training_users_first(spark, d):
    dim = encode.dense_index(T.interactions(spark, d).select("user_id"), "user_id")
    return encode.first_labels(dim, 100).select("user_id", "idx")


@register("top_categories", "A8,A9,W8", """
    with top as (select main_category as category, count(*) as n from v_items
                 where main_category is not null group by main_category
                 order by n desc, category limit 10)
    select category, n, round(n * 100.0 / sum(n) over (), 1) as share_of_top from top""")
def q_top_categories(spark, d):
    return ratings.top_categories(T.items(spark, d))


KEY_HASH = "md5('42|' || user_id || '|' || item_id || '|' || epoch_us(ts))"


@register("hash_split_counts", "M4", f"""
    select case when cast('0x' || substr({KEY_HASH}, 1, 8) as bigint) % 10000 < 8000 then 'train' else 'test' end as part, count(*) as n
    from v_interactions group by 1""")
def q_hash_split_counts(spark, d):
    inter = T.interactions(spark, d)
    share = ratings.split_share(inter, ["user_id", "item_id", "ts"])
    return inter.groupBy(F.when(share < 8000, "train").otherwise("test").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@register("hash_sample", "S5", f"""
    select user_id, item_id, rating, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts
    from (select * from v_interactions order by {KEY_HASH}, user_id, item_id, ts, rating limit 1000)""")
def q_hash_sample(spark, d):
    r = T.interactions(spark, d)
    return ratings.hash_sample(r, ["user_id", "item_id", "ts"], 1000).select(
        "user_id", "item_id", "rating", ts_text("ts").alias("ts"))


@register("training_split", "M4,M3,P8,J8", """
    with r as (select user_id, item_id, rating from
                 (select *, row_number() over (partition by item_id, user_id order by ts desc, rating desc) rn from v_interactions) where rn = 1),
         u as (select user_id, row_number() over (order by count(*) desc, user_id) - 1 as idx from v_interactions group by user_id),
         i as (select item_id, row_number() over (order by count(*) desc, item_id) - 1 as idx from v_interactions group by item_id)
    select case when cast('0x' || substr(md5('42|' || u.user_id || '|' || i.item_id), 1, 8) as bigint) % 10000 < 8000 then 'train' else 'test' end as part,
           i.item_id, count(*) as n, cast(sum(u.idx) as bigint) as sum_user_idx, sum(rating) as sum_rating
    from r join u using (user_id) join i using (item_id) where i.idx < 500 group by all""")
def q_training_split(spark, d):
    """The encoded split as training sees it, decoded again: per part and item label (of the 500 commonest items) its rows. Indexes without a label
    in the shortened dictionary drop out."""
    path = f"{scratch_folder(spark, 'pairs')}/fact"
    ratings.pair_fact(T.interactions(spark, d)).write.parquet(path)
    pairs = spark.read.parquet(path)
    udim = encode.dense_index(pairs.select("user_id", "n"), "user_id", weight_col="n")
    idim = encode.dense_index(pairs.select("item_id", "n"), "item_id", weight_col="n")
    enc = encode.encode_ratings(ratings.newest_of(pairs), udim, idim)
    part = F.when(ratings.split_share(enc, ["user_id", "item_id"]) < 8000, "train").otherwise("test")
    indexed = enc.select(part.alias("part"), "user_idx", "item_idx", "rating")
    decoded = encode.labels_to_items(indexed, encode.first_labels(idim, 500), "item_idx", "item_id")
    return decoded.groupBy("part", "item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("user_idx").alias("sum_user_idx"), F.sum("rating").alias("sum_rating"))


@register("distinct_items", "A3", "select distinct item_id from v_interactions")
def q_distinct_items(spark, d):
    return T.interactions(spark, d).select("item_id").distinct()


@register("event_messages", "F4,F5,F14,F16,K8,ST1", """
    select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as iso_ts,
           'USER_' || cast(cast(floor(epoch(ts)) as bigint) as varchar) as user_key,
           strftime(to_timestamp(cast(floor(epoch(ts)) as bigint)) at time zone 'UTC', '%Y-%m-%d %H:%M:%S.%f')
             as second_ts,
           event_type, item_id
    from v_activity""")
def q_event_messages(spark, d):
    """Events rendered as the reference's JSON messages and parsed back (a
    round trip through to_json / from_json), with ISO text and epoch ids."""
    from ..functions.text import iso_text, user_id_from_time
    from ..streaming.activity import EVENT_SCHEMA
    a = T.activity(spark, d)
    msg = a.select("event_id", "ts", F.to_json(F.struct(
        "event_type", F.col("user_id").cast("string").alias("user_id"),
        iso_text("ts").alias("timestamp"), F.col("item_id").cast("string").alias("asin"))).alias("value"))
    parsed = msg.select("event_id", "ts", F.from_json("value", EVENT_SCHEMA).alias("e"))
    return parsed.select(
        "event_id", F.col("e.timestamp").alias("iso_ts"), user_id_from_time("ts").alias("user_key"),
        ts_text(F.timestamp_seconds(F.unix_timestamp("ts"))).alias("second_ts"),
        F.col("e.event_type").alias("event_type"), F.col("e.asin").cast("bigint").alias("item_id"))


@register("item_vector_table", "M8,F2,J2", """
    select f.item_id, 'v1' as model_version, cast(len(f.features) as bigint) as dim, i.idx
    from v_item_factors f join
      (select item_id, row_number() over (order by count(*) desc, item_id) - 1 as idx
       from v_interactions group by item_id) i using (item_id)""")
def q_item_vector_table(spark, d):
    idim = encode.dense_index(T.interactions(spark, d).select("item_id"), "item_id")
    f = T.item_factors(spark, d)
    return (f.join(idim.select("item_id", "idx"), "item_id")
            .select("item_id", F.lit("v1").alias("model_version"),
                    F.size("features").cast("bigint").alias("dim"), "idx"))
