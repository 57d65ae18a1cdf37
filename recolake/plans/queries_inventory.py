"""Registered queries: key inventory reports, users, search documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ts_text
from ..functions.vectors import has_vector
from ..operators import document_store as DS
from ..operators import documents as D
from ..operators import inventory as I
from ..operators import users as U
from ..session import scratch_folder
from ..sources import tables as T
from .catalog import register

# 2-decimal text from integer arithmetic, the same construction as functions.text.fixed2
# (all arithmetic in double, in the same order as the Spark expressions)
F2 = ("(cast(floor(cast(({v}) as double) * 100.0 + 0.5) as bigint) // 100)::varchar || '.' || "
      "lpad((cast(floor(cast(({v}) as double) * 100.0 + 0.5) as bigint) % 100)::varchar, 2, '0')")
FMT = ("case when {x} < 1024 then " + F2.format(v="cast({x} as double)") + " || ' B' "
       "when {x} < 1048576 then " + F2.format(v="cast({x} as double) / 1024.0") + " || ' KB' "
       "when {x} < 1073741824 then " + F2.format(v="cast({x} as double) / 1048576.0") + " || ' MB' "
       "when {x} < 1099511627776 then " + F2.format(v="cast({x} as double) / 1073741824.0") + " || ' GB' "
       "else " + F2.format(v="cast({x} as double) / 1099511627776.0") + " || ' TB' end")


@register("cache_key_totals", "A15,P13,F10", f"""
    select 'recs:*' as pattern, cast(coalesce(sum(size_bytes), 0) as bigint) as total_bytes,
           {FMT.format(x='coalesce(sum(size_bytes), 0)')} as total_size, count(*) as total_keys
    from v_key_inventory where key like 'recs:%' and coalesce(size_bytes, 0) <> 0""")
def q_cache_key_totals(spark, d):
    return I.key_size_totals(T.key_inventory(spark, d), "recs:*")


@register("largest_cache_keys", "A15,P13,F10", f"""
    select row_number() over (order by size_bytes desc, key) as rank, key, size_bytes,
           {FMT.format(x='size_bytes')} as size
    from v_key_inventory where coalesce(size_bytes, 0) <> 0
    order by size_bytes desc, key limit 10""")
def q_largest_keys(spark, d):
    return I.largest_keys(T.key_inventory(spark, d), "*", 10)


@register("key_type_distribution", "A16", """
    select type, count(*) as n from v_key_inventory group by rollup (type)""")
def q_key_types(spark, d):
    return I.key_type_distribution(T.key_inventory(spark, d))


@register("expiry_buckets", "A17", """
    select count(*) filter (where ttl_s > 0) as total_expiring,
           count(*) filter (where ttl_s > 0 and ttl_s < 3600) as expiring_within_1h,
           count(*) filter (where ttl_s > 0 and ttl_s < 86400) as expiring_within_1d
    from v_key_inventory""")
def q_expiry(spark, d):
    return I.expiry_buckets(T.key_inventory(spark, d))


@register("recommendation_cache", "A18,U3,F15", """
    select count(*) as total_cached_recommendations,
           count(distinct split_part(key, ':', 2)) as users_with_cache
    from v_key_inventory where key like 'recs:%'""")
def q_rec_cache(spark, d):
    return I.recommendation_cache(T.key_inventory(spark, d))


@register("search_cache", "A19", """
    select count(*) as total_cached_searches, count(*) as unique_queries
    from v_key_inventory where key like 'search:%'""")
def q_search_cache(spark, d):
    return I.search_cache(T.key_inventory(spark, d))


@register("keys_per_db", "A21", """
    select db, count(*) as keys, count(*) filter (where ttl_s > 0) as expires,
           avg(case when ttl_s > 0 then ttl_s end) as avg_ttl
    from v_key_inventory group by rollup (db)""")
def q_keys_per_db(spark, d):
    return I.keys_per_db(T.key_inventory(spark, d))


@register("trending_totals", "A22,F18", """
    select cast(least(count(distinct case when event_type = 'product_view' then item_id end), 100) as bigint)
             as total_viewed_products,
           cast(least(count(distinct case when event_type = 'purchase' then item_id end), 100) as bigint)
             as total_purchased_products
    from v_activity where item_id is not null and event_type in ('product_view', 'purchase')""")
def q_trending_totals(spark, d):
    return I.trending_totals(T.activity(spark, d))


@register("inventory_report", "K12,A15,A16,A17,A18,A19,A21,A22", f"""
    with inv as (select * from v_key_inventory),
    ks as (select cast(coalesce(sum(size_bytes), 0) as bigint) as tb, count(*) as tk
           from inv where coalesce(size_bytes, 0) <> 0),
    tr as (select least(count(distinct case when event_type = 'product_view' then item_id end), 100) as v,
                  least(count(distinct case when event_type = 'purchase' then item_id end), 100) as p
           from v_activity where item_id is not null and event_type in ('product_view', 'purchase'))
    select 'key_sizes' as section, 'total_bytes' as metric, cast(tb as varchar) as value from ks
    union all select 'key_sizes', 'total_size', {FMT.format(x='tb')} from ks
    union all select 'key_sizes', 'total_keys', cast(tk as varchar) from ks
    union all select 'expiry', 'total_expiring', cast(count(*) filter (where ttl_s > 0) as varchar) from inv
    union all select 'expiry', 'expiring_within_1h',
                     cast(count(*) filter (where ttl_s > 0 and ttl_s < 3600) as varchar) from inv
    union all select 'expiry', 'expiring_within_1d',
                     cast(count(*) filter (where ttl_s > 0 and ttl_s < 86400) as varchar) from inv
    union all select 'recommendation_cache', 'total_cached_recommendations', cast(count(*) as varchar)
              from inv where key like 'recs:%'
    union all select 'recommendation_cache', 'users_with_cache',
                     cast(count(distinct split_part(key, ':', 2)) as varchar) from inv where key like 'recs:%'
    union all select 'search_cache', 'total_cached_searches', cast(count(*) as varchar)
              from inv where key like 'search:%'
    union all select 'search_cache', 'unique_queries', cast(count(*) as varchar) from inv where key like 'search:%'
    union all select 'trending', 'total_viewed_products', cast(v as varchar) from tr
    union all select 'trending', 'total_purchased_products', cast(p as varchar) from tr
    union all select 'key_types', coalesce(type, 'total'), cast(count(*) as varchar) from inv group by rollup (type)
    union all select 'keys_per_db', coalesce(db, 'total'), cast(count(*) as varchar) from inv group by rollup (db)
    union all select 'key_types', 'type_count', cast(count(distinct type) as varchar) from inv
    union all select 'expires_per_db', coalesce(db, 'total'), cast(count(*) filter (where ttl_s > 0) as varchar) from inv group by rollup (db)
    union all select 'avg_ttl_per_db', coalesce(db, 'total'),
                     cast(cast(floor(sum(ttl_s) filter (where ttl_s > 0) / count(*) filter (where ttl_s > 0)) as bigint) as varchar) from inv group by rollup (db)
    union all select * from (
      select case event_type when 'purchase' then 'top_purchased' else 'top_viewed' end as section, cast(item_id as varchar), cast(count(*) as varchar)
      from v_activity where item_id is not null and event_type in ('product_view', 'purchase') group by event_type, item_id
      qualify row_number() over (partition by event_type order by count(*) desc, item_id desc) <= 10)""")
def q_inventory_report(spark, d):
    return I.inventory_report(T.keys_and_events(spark, d))


USERS_SQL = """
    with batch as (select user_id, row_number() over (order by event_id) - 1 as position
                   from v_activity where event_type = 'purchase' and user_id is not null),
         existing as (select distinct user_id from v_activity where event_type = 'user_registration'),
         firsts as (select user_id, min(position) as first_pos from batch group by user_id),
         flagged as (select b.user_id, b.position,
                            e.user_id is null and b.position = f.first_pos as inserted
                     from batch b join firsts f using (user_id) left join existing e using (user_id))"""


@register("insert_users", "G1,J6,W9,F13,S6", USERS_SQL + """
    select user_id, position, inserted,
           case when inserted then printf('user_%03d_%s', position, substr(cast(user_id as varchar), 1, 8)) end
             as username,
           case when inserted then printf('user_%03d_%s', position, substr(cast(user_id as varchar), 1, 8))
                                   || '@example.com' end as email
    from flagged""")
def q_insert_users(spark, d):
    r = U.insert_users(_purchase_batch(spark, d), _registered(spark, d), [F.col("event_id")])
    return r.select("user_id", "position", "inserted", "username", "email")


@register("insert_user_counts", "G1,J6,A6", USERS_SQL + """
    select count(*) filter (where inserted) as inserted, count(*) filter (where not inserted) as skipped
    from flagged""")
def q_insert_counts(spark, d):
    r = U.insert_users(_purchase_batch(spark, d), _registered(spark, d), [F.col("event_id")])
    return U.insert_counts(r)


def _purchase_batch(spark, d):
    return (T.activity(spark, d, ("purchase",)).filter(F.col("user_id").isNotNull())
            .select("event_id", "user_id"))


def _registered(spark, d):
    """Registered users: first registration event per user (created_at)."""
    return (T.activity(spark, d, ("user_registration",))
            .groupBy("user_id").agg(F.min("ts").alias("created_at")))


@register("newest_users", "G2,L9", """
    select user_id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') as created_at from
      (select user_id, min(ts) as created_at from v_activity where event_type = 'user_registration'
       group by user_id)
    order by created_at desc, user_id limit 5""")
def q_newest_users(spark, d):
    n = U.newest_users(_registered(spark, d), 5)
    return n.select("user_id", ts_text("created_at").alias("created_at"))


@register("search_documents", "J1,K6,P9,P11,P15,W7", """
    select i.item_id as doc_id, i.title, i.main_category,
           v.model_factor is not null and len(v.model_factor) > 0 as has_vector,
           cast(coalesce(len(v.model_factor), 0) as bigint) as vector_dim
    from v_items i left join v_item_vectors v using (item_id)""")
def q_search_documents(spark, d):
    items = T.products(spark, d).select("item_id", "title", "main_category")
    docs = D.product_documents(items, T.item_vectors(spark, d))
    # the index is loaded as: documents without vector first, vectors merged in by upsert
    base = docs.withColumn("model_factor", F.lit(None).cast("array<float>"))
    merged = D.upsert(base, docs.filter(has_vector("model_factor")), "doc_id")
    return merged.select("doc_id", "title", "main_category",
                         has_vector("model_factor").alias("has_vector"),
                         F.coalesce(F.size("model_factor"), F.lit(0)).cast("bigint").alias("vector_dim"))


@register("display_items", "P14", """
    select item_id, substr(title, 1, 50) as short_title, cast(floor(average_rating) as bigint) as stars
    from v_items""")
def q_display_items(spark, d):
    return D.display_projection(T.items(spark, d))


@register("display_products", "P14", f"""
    with words as (select item_id, title, description, features,
                          regexp_extract_all(description, '[^ \\x09-\\x0D]+') as w from v_described_lists),
    scored as (select words.*, s.average_rating from words left join v_item_stats s using (item_id))
    select item_id, substr(title, 1, 60) as short_title, substr(description, 1, 150) as short_text,
           array_to_string(w[1:3], '|') as descriptions, array_to_string(features[1:5], '|') as features,
           {F2.format(v='average_rating')} as score
    from scored""")
def q_display_products(spark, d):
    """The product and result pages: text of 150 characters, three descriptions, five features, a score of two decimals."""
    items = T.described_products(spark, d).join(T.item_stats(T.interactions(spark, d)), "item_id", "left")
    parts = items.withColumn("descriptions", F.regexp_extract_all("description", F.lit(r"[^ \x09-\x0D]+"), F.lit(0)))
    return D.product_page(parts).select("item_id", "short_title", "short_text", F.array_join("descriptions", "|").alias("descriptions"),
                                        F.array_join("features", "|").alias("features"), "score")


@register("page_image_urls", "F12,P15", """
    select page_id, case page_id % 3 when 0 then 'large:' || url || '|thumb:' || url when 1 then 'thumb:' || url else '' end as urls from pages""")
def q_page_image_urls(spark, d):
    """Image objects over the page urls: both sizes and a second one with a thumb only, a thumb only, or neither; the internal id goes."""
    pages = T.read(spark, d, "pages")
    kind, kinds = F.col("page_id") % 3, "struct<thumb:string,large:string>"
    thumb, large = F.concat(F.lit("thumb:"), "url"), F.concat(F.lit("large:"), "url")
    image = lambda t, l: F.struct(t.cast("string").alias("thumb"), l.cast("string").alias("large"))
    none = F.lit(None)
    images = F.when(kind == 0, F.array(image(thumb, large), image(none, none), image(thumb, none))).when(
        kind == 1, F.array(image(thumb, none))).otherwise(F.array(image(none, none)))
    items = pages.select(F.col("page_id").alias("item_id"), F.lit("x").alias("_id"), images.cast(f"array<{kinds}>").alias("images"))
    vectors = T.item_vectors(spark, d).limit(0)
    docs = D.product_documents(items, vectors)
    return docs.select([c for c in docs.columns if c not in ("doc_id", "model_factor")]).select(
        F.col("item_id").alias("page_id"), F.array_join("images", "|").alias("urls"))


@register("spoken_lines", "F17,S6", """
    select trim(line) as user_id from (select unnest(string_split(text, chr(10))) as line from conversations) where trim(line) <> ''""")
def q_spoken_lines(spark, d):
    """Lines trimmed, blank ones dropped: what reading an id list does, over the lines of all turns."""
    return U.clean_id_lines(T.read(spark, d, "conversations").select(F.explode(F.split("text", "\n")).alias("value")))


@register("event_documents", "K6,W7,P9", """
    with e as (select coalesce(item_id, -1) as doc_id, event_id, event_type, user_id, value from v_activity where item_id is not null),
    last as (select * from e qualify row_number() over (partition by doc_id order by event_id desc) = 1)
    select doc_id, event_id as seq, user_id, value from last where event_type <> 'user_registration'""")
def q_event_documents(spark, d):
    """Events as writes to their item's document, in order of event_id; a registration event deletes it. Three batches, out of order,
    are merged into a bucketed snapshot: the last write of each id stays, rows without an item are no documents."""
    e = T.activity(spark, d).select(F.col("item_id").alias("doc_id"), F.col("event_id").alias("seq"), "user_id", "value",
                                    (F.col("event_type") == "user_registration").alias("deleted"))
    store = DS.DocumentStore(scratch_folder(spark, "documents"), buckets=8)
    for k in (1, 2, 0):
        store.merge(e.filter(F.col("seq") % 3 == k))
    return store.read(spark).select("doc_id", "seq", "user_id", "value")
