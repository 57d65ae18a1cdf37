"""Registered queries: popularity, history, similar items, CF and hybrid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ts_text
from ..operators import cf, encode, hybrid, popular, ratings, similarity
from ..session import scratch_folder
from ..sources import tables as T
from .catalog import register

POP = """(select row_number() over (order by rating_number desc nulls last, item_id) as rank, item_id,
                 cast(coalesce(rating_number, 0) as double) / 1000.0 as score
          from v_items order by rating_number desc nulls last, item_id limit {n})"""

DOT = "list_dot_product(cast({a} as double[]), cast({b} as double[]))"


def _cos(a: str, b: str) -> str:
    na = f"sqrt({DOT.format(a=a, b=a)})"
    nb = f"sqrt({DOT.format(a=b, b=b)})"
    return f"(case when {na} > 0 and {nb} > 0 then {DOT.format(a=a, b=b)} / ({na} * {nb}) else 0.0 end)"


@register("popular_items", "L1,F9,P11", f"select * from {POP.format(n=10)}")
def q_popular_items(spark, d):
    return popular.popular_items(T.items(spark, d), 10)


@register("category_hot_items", "L2,P5,W1", """
    select main_category, rank, item_id, score from
      (select main_category, item_id, cast(coalesce(rating_number, 0) as double) / 1000.0 as score,
              row_number() over (partition by main_category
                                 order by rating_number desc nulls last, item_id) as rank
       from v_items where main_category is not null)
    where rank <= 5""")
def q_category_hot(spark, d):
    return popular.category_hot_items(T.items(spark, d), 5)


@register("user_history", "L3,P6,W1", """
    select user_id, rank, item_id, rating, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts from
      (select *, row_number() over (partition by user_id order by ts desc, item_id, rating) as rank
       from v_interactions)
    where rank <= 20""")
def q_user_history(spark, d):
    h = popular.user_history(T.interactions(spark, d), 20)
    return h.select("user_id", "rank", "item_id", "rating", ts_text("ts").alias("ts"))


def _event_top(event_type: str, n: int, enrich: bool) -> str:
    body = f"""(select row_number() over (order by n desc, item_id desc) as rank, item_id, n from
                 (select item_id, count(*) as n from v_activity
                  where event_type = '{event_type}' and item_id is not null group by item_id)
                order by n desc, item_id desc limit {n})"""
    if not enrich:
        return f"select rank, item_id, n from {body}"
    return f"""select t.rank, t.item_id, t.n, i.title, i.main_category, i.average_rating, i.rating_number
               from {body} t join v_items i using (item_id)"""


@register("trending_products", "L4,A12,J3,R5", _event_top("product_view", 20, True))
def q_trending(spark, d):
    t = popular.trending(T.activity(spark, d, ("product_view",)), 20, "product_view")
    return popular.enrich(t, T.items(spark, d))


@register("hot_products", "L5,J3,R5", _event_top("purchase", 20, True))
def q_hot(spark, d):
    t = popular.trending(T.activity(spark, d, ("purchase",)), 20, "purchase")
    return popular.enrich(t, T.items(spark, d))


@register("item_views", "A12,ST3", """
    select item_id, count(*) as n from v_activity
    where event_type = 'product_view' and item_id is not null group by item_id""")
def q_item_views(spark, d):
    return popular.event_counts(T.activity(spark, d, ("product_view",)), "product_view")


@register("category_popular", "L6,A13,R5,W1", """
    select main_category, item_id, n, rank from
      (select i.main_category, v.item_id, v.n,
              row_number() over (partition by i.main_category order by v.n desc, v.item_id desc) as rank
       from (select item_id, count(*) as n from v_activity
             where event_type = 'product_view' and item_id is not null group by item_id) v
       join v_items i using (item_id) where i.main_category is not null)
    where rank <= 20""")
def q_category_popular(spark, d):
    return popular.category_popular(T.activity(spark, d, ("product_view",)), T.products(spark, d), 20).select(
        "main_category", "item_id", "n", "rank")


@register("recent_views_global", "W4,R5,L9", """
    select row_number() over (order by ts desc, event_id desc) as rank, event_id, user_id, item_id,
           strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts
    from v_activity where event_type = 'product_view' order by ts desc, event_id desc limit 100""")
def q_recent_global(spark, d):
    r = popular.recent_global(T.activity(spark, d, ("product_view",)), 100)
    return r.select("rank", "event_id", "user_id", "item_id", ts_text("ts").alias("ts"))


@register("recent_products", "R5,W4,J3", """
    with r as (select row_number() over (order by ts desc, event_id desc) as rank, event_id, user_id, item_id
               from v_activity where event_type = 'product_view' order by ts desc, event_id desc limit 100)
    select r.rank, r.event_id, r.user_id, r.item_id, i.title, i.main_category, i.average_rating, i.rating_number from r join v_items i using (item_id)""")
def q_recent_products(spark, d):
    """The recently viewed page: the newest views with their products; views of unknown products are left out."""
    r = popular.recent_global(T.activity(spark, d, ("product_view",)), 100).select("rank", "event_id", "user_id", "item_id")
    return popular.enrich(r, T.items(spark, d))


@register("category_products", "R5,L6,J3", """
    with c as (select main_category, item_id, n, rank from
      (select i.main_category, v.item_id, v.n, row_number() over (partition by i.main_category order by v.n desc, v.item_id desc) as rank
       from (select item_id, count(*) as n from v_activity where event_type = 'product_view' and item_id is not null group by item_id) v
       join v_items i using (item_id) where i.main_category is not null) where rank <= 20)
    select c.main_category, c.item_id, c.n, c.rank, i.title, i.average_rating, i.rating_number from c join v_items i using (item_id)""")
def q_category_products(spark, d):
    """The category page: a category's most viewed products as they are shown."""
    top = popular.category_popular(T.activity(spark, d, ("product_view",)), T.products(spark, d), 20).select("main_category", "item_id", "n", "rank")
    return popular.enrich(top, T.items(spark, d), cols=("title", "average_rating", "rating_number"))


@register("recent_views_per_user", "W3,R5", """
    select user_id, rank, event_id, item_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts from
      (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rank
       from v_activity where event_type = 'product_view' and user_id is not null)
    where rank <= 100""")
def q_recent_per_user(spark, d):
    r = popular.recent_per_user(T.activity(spark, d, ("product_view",)), 100)
    return r.select("user_id", "rank", "event_id", "item_id", ts_text("ts").alias("ts"))


def _similar_sql(score_expr: str) -> str:
    return f"""
    with vi as (select i.item_id, i.main_category, v.model_factor
                from v_items i left join v_item_vectors v using (item_id)),
         q as (select * from vi where model_factor is not null and len(model_factor) > 0
                                  and main_category is not null),
         pairs as (select q.item_id, c.item_id as similar_id,
                          case when c.model_factor is not null and len(c.model_factor) > 0
                               then {score_expr} else 0.0 end as score
                   from q join vi c on q.main_category = c.main_category and q.item_id <> c.item_id)
    select item_id, rank, similar_id, score from
      (select *, row_number() over (partition by item_id order by round(score, 9) desc, similar_id) as rank
       from pairs)
    where rank <= 10"""


@register("similar_items", "R3,R4,J7,F6,P7,P11,W2",
          _similar_sql(_cos("q.model_factor", "c.model_factor") + " + 1.0"))
def q_similar_items(spark, d):
    return similarity.similar_items(T.products(spark, d), T.item_vectors(spark, d), 10, "cosine")


@register("similar_items_logistic", "R3,J7,F7,W2",
          _similar_sql("1.0 / (1.0 + exp(-" + DOT.format(a="q.model_factor", b="c.model_factor") + "))"))
def q_similar_items_logistic(spark, d):
    return similarity.similar_items(T.products(spark, d), T.item_vectors(spark, d), 10, "logistic")


CLS = """
    dim as (select distinct user_id from v_interactions),
    req as (select distinct user_id from v_customers),
    fac as (select distinct user_id from v_user_factors),
    cls as (select r.user_id, d.user_id is not null as known, f.user_id is not null as has_factor
            from req r left join dim d using (user_id) left join fac f using (user_id))"""


def _cf_sql(n: int) -> str:
    return f"""
    cfall as (select u.user_id, i.item_id, {DOT.format(a='u.features', b='i.features')} as score
              from v_user_factors u join cls using (user_id) cross join v_item_factors i
              where cls.known and cls.has_factor and len(u.features) > 0 and len(i.features) > 0),
    cfr as (select user_id, rank, item_id, score, 'cf' as source from
              (select *, row_number() over (partition by user_id order by round(score, 9) desc, item_id) as rank
               from cfall) where rank <= {n}),
    popn as {POP.format(n=n)},
    cfl as (select * from cfr union all
            select c.user_id, p.rank, p.item_id, p.score, 'popular' as source
            from cls c cross join popn p where not c.known)"""


@register("user_classes", "J5,P12", f"with {CLS} select user_id, known, has_factor from cls")
def q_user_classes(spark, d):
    return cf.user_classes(T.customers(spark, d), T.interactions(spark, d), T.user_factors(spark, d))


@register("cf_recommendations", "R1,M10,J5,J8,W1,P8", f"with {CLS}, {_cf_sql(10)} select * from cfl")
def q_cf(spark, d):
    inter = T.interactions(spark, d)
    return cf.collaborative_recommendations(
        T.customers(spark, d), inter, T.user_factors(spark, d),
        T.item_factors(spark, d), T.items(spark, d, inter), 10)


@register("user_page_recs", "J4,R6,L11", f"""
    with {CLS}, {_cf_sql(10)}
    select c.user_id, c.rank, c.item_id, c.score, c.source, i.title
    from cfl c left join v_items i using (item_id) where c.rank <= 5""")
def q_user_page(spark, d):
    recs = hybrid.recommend(T.customers(spark, d), "cf", T.interactions(spark, d),
                            T.user_factors(spark, d), T.item_factors(spark, d), T.items(spark, d), 10)
    recs = popular.slice_list(recs, 5)
    return popular.enrich(recs, T.items(spark, d), "left", ("title",))


HYBRID_SQL = f"""
    with {CLS}, {_cf_sql(20)},
    pop20 as {POP.format(n=20)},
    blended as (select c.user_id, c.item_id,
                       0.6 * c.score + case when coalesce(i.average_rating, 0) <> 0
                                            then 0.4 * i.average_rating / 5.0 else 0.0 end as score
                from cfl c join v_items i using (item_id)),
    best as (select user_id, rank, item_id, score, 'hybrid' as source from
               (select *, row_number() over (partition by user_id order by round(score, 9) desc, item_id) as rank
                from blended) where rank <= 10),
    cnt as (select l.user_id, coalesce(b.n, 0) as n
            from (select distinct user_id from cfl) l
            left join (select user_id, count(*) as n from best group by user_id) b using (user_id)
            where coalesce(b.n, 0) < 10),
    padc as (select c.user_id, c.n, p.rank as prank, p.item_id, p.score from cnt c cross join pop20 p
             where not exists (select 1 from best b where b.user_id = c.user_id and b.item_id = p.item_id)),
    pads as (select user_id, n + r as rank, item_id, score, 'popular_pad' as source from
               (select *, row_number() over (partition by user_id order by prank) as r from padc)
             where r <= 10 - n),
    pop5 as (select rank, item_id, score from pop20 where rank <= 5),
    hot5 as (select row_number() over (order by rating_number desc nulls last, item_id) as rank, item_id,
                    cast(coalesce(rating_number, 0) as double) / 1000.0 as score
             from v_items where main_category = 'PROMO'
             order by rating_number desc nulls last, item_id limit 5),
    mixlist as (select rank as pos, item_id, score, 'popular' as source from pop5 union all
                select (select count(*) from pop5) + rank, item_id, score, 'category_hot' from hot5),
    mixed as (select e.user_id, m.pos as rank, m.item_id, m.score, m.source
              from (select user_id from cls where known and not has_factor) e cross join mixlist m
              where m.pos <= 10)
    select * from best union all select * from pads union all select * from mixed"""


@register("hybrid_recommendations", "R2,R6,F8,J3,U1,U2,L7,W1", HYBRID_SQL)
def q_hybrid(spark, d):
    inter = T.interactions(spark, d)
    # the product table feeds five branches (blend, pad pool, two fallback lists, ...):
    # written once to the shared checkpoint dir instead of re-aggregating the fact table
    items = T.items(spark, d, inter).checkpoint(eager=True)
    return hybrid.hybrid_recommendations(
        T.customers(spark, d), inter, T.user_factors(spark, d),
        T.item_factors(spark, d), items, 10, fallback_category="PROMO")


@register("factor_predictions_eval", "M6,A7,M7,P3", f"""
    with r as (select item_id, user_id, rating from
                 (select *, row_number() over (partition by item_id, user_id order by ts desc, rating desc) rn
                  from v_interactions) where rn = 1),
         p as (select r.rating, {DOT.format(a='u.features', b='i.features')} as prediction
               from r join v_user_factors u using (user_id) join v_item_factors i using (item_id))
    select sqrt(avg((prediction - rating) * (prediction - rating))) as rmse,
           avg(abs(prediction - rating)) as mae, count(*) as n from p""")
def q_predictions_eval(spark, d):
    r = ratings.prepare_ratings_first(T.interactions(spark, d))
    pred = cf.predict_pairs(r, T.user_factors(spark, d), T.item_factors(spark, d))
    return cf.regression_metrics(pred)


_MODELS: dict = {}


def _als(spark, d, variant: str = "A"):
    """Fit once per (application, data, variant): encode, hash split, ALS. The split is written to the shared folder, not kept in memory.
    A = rank 25, reg 0.01, nonnegative; B = rank 50, reg 0.1, unconstrained."""
    key = (spark.sparkContext.applicationId, d, variant)
    if key not in _MODELS:
        path = scratch_folder(spark, "als")
        ratings.pair_fact(T.interactions(spark, d)).write.parquet(f"{path}/pairs")
        pairs = spark.read.parquet(f"{path}/pairs")
        udim = encode.dense_index(pairs.select("user_id", "n"), "user_id", weight_col="n")
        idim = encode.dense_index(pairs.select("item_id", "n"), "item_id", weight_col="n")
        enc = encode.encode_ratings(ratings.newest_of(pairs), udim, idim)
        share = ratings.split_share(enc, ["user_id", "item_id"])
        (enc.select(F.col("user_idx").cast("int"), F.col("item_idx").cast("int"), "rating", (share < 8000).cast("int").alias("train"))
         .write.partitionBy("train").parquet(f"{path}/split"))
        split = spark.read.parquet(f"{path}/split")
        train, test = split.filter("train = 1").drop("train"), split.filter("train = 0").drop("train")
        params = (dict(rank=25, reg_param=0.01, nonnegative=True) if variant == "A"
                  else dict(rank=50, reg_param=0.1, nonnegative=False))
        _MODELS[key] = (cf.fit_als(train, **params), udim, idim, train, test)
    return _MODELS[key]


@register("als_fit_metrics", "M4,M5,M6,M7,M12,A7", None)
def q_als_metrics(spark, d):
    model, udim, idim, train, test = _als(spark, d)
    m = cf.regression_metrics(model.transform(test).na.drop())
    return m.select("rmse", "mae", F.col("n").alias("n_test"),
                    train.agg(F.count(F.lit(1))).scalar().alias("n_train"), F.lit(25).alias("rank"))


@register("als_recommendations", "M5,M8,M9,M10,J2,J8", None)
def q_als_recs(spark, d):
    model, udim, idim, _, _ = _als(spark, d)
    uf, itf = cf.factors_from_model(model, udim, idim)
    return cf.collaborative_recommendations(T.customers(spark, d), T.interactions(spark, d), uf, itf,
                                            T.items(spark, d), 10)


TRAIN = """
    with r as (select user_id, item_id from
                 (select *, row_number() over (partition by item_id, user_id order by ts desc, rating desc) rn from v_interactions) where rn = 1),
         t as (select user_id, item_id, cast('0x' || substr(md5('42|' || user_id || '|' || item_id), 1, 8) as bigint) % 10000 < 8000 as train from r),"""


@register("als_recommendation_ranks", "M5,M8,M9,M10,P8,J8", f"""{TRAIN}
         known as (select distinct user_id from v_interactions),
         trained as (select distinct user_id from t where train),
         n as (select least(10, count(distinct item_id)) as k from t where train),
         p as (select least(10, count(*)) as k from v_items)
    select c.user_id, r.rank, case when k.user_id is not null then 'cf' else 'popular' end as source, true as labelled
    from v_customers c left join known k using (user_id) left join trained f using (user_id), n, p, (select unnest(range(1, 11)) as rank) r
    where (k.user_id is not null and f.user_id is not null and r.rank <= n.k) or (k.user_id is null and r.rank <= p.k)""")
def q_als_ranks(spark, d):
    """Who gets a list from the trained model, how long it is, and that every item of it is a label of the item dictionary."""
    labels = _als(spark, d)[2].select("item_id", F.lit(True).alias("known"))
    rows = q_als_recs(spark, d).join(labels, "item_id", "left")
    return rows.select("user_id", "rank", "source", (F.coalesce("known", F.lit(False)) | (F.col("source") == "popular")).alias("labelled"))


@register("als_split_sizes", "M4,M5,M7,M12", f"""{TRAIN}
         s as (select count(*) filter (where train) as n_train, count(*) filter (where not train) as n_held from t),
         h as (select count(*) as n_test from t where not train and user_id in (select user_id from t where train) and item_id in (select item_id from t where train))
    select s.n_train, s.n_held, h.n_test from s, h""")
def q_als_split_sizes(spark, d):
    """Rows that the model is trained on, held out, and predicted: pairs of a user or an item that training never saw are dropped."""
    model, _, _, train, test = _als(spark, d)
    return model.transform(test).na.drop().agg(F.count(F.lit(1)).alias("n_test")).select(
        train.agg(F.count(F.lit(1))).scalar().alias("n_train"), test.agg(F.count(F.lit(1))).scalar().alias("n_held"), "n_test")


@register("sql_prediction_errors", "M6,A7,F6,F7", f"""
    with r as (select item_id, user_id, rating from
                 (select *, row_number() over (partition by item_id, user_id order by ts desc, rating desc) rn
                  from v_interactions) where rn = 1),
         p as (select r.rating, {DOT.format(a='u.features', b='i.features')} as prediction,
                      {_cos('u.features', 'i.features')} as cosine
               from r join v_user_factors u using (user_id) join v_item_factors i using (item_id))
    select sqrt(avg((prediction - rating) * (prediction - rating))) as rmse,
           avg(abs(prediction - rating)) as mae, avg(cosine) as mean_cosine, count(*) as n from p""")
def q_sql_prediction_errors(spark, d):
    """The same evaluation written in Spark SQL with the registered SQL functions."""
    from ..functions.sql import register_sql_functions
    register_sql_functions(spark)
    r = ratings.prepare_ratings_first(T.interactions(spark, d))
    r.createOrReplaceTempView("recolake_ratings")
    T.user_factors(spark, d).createOrReplaceTempView("recolake_user_factors")
    T.item_factors(spark, d).createOrReplaceTempView("recolake_item_factors")
    return spark.sql("""
        select sqrt(avg(pow(vec_dot(u.features, i.features) - r.rating, 2))) as rmse,
               avg(abs(vec_dot(u.features, i.features) - r.rating)) as mae,
               avg(vec_cosine(u.features, i.features)) as mean_cosine, count(*) as n
        from recolake_ratings r
        join recolake_user_factors u on u.user_id = r.user_id
        join recolake_item_factors i on i.item_id = r.item_id""")


@register("similar_items_api", "R4,R3,J3", f"""
    with s as ({_similar_sql(_cos("q.model_factor", "c.model_factor") + " + 1.0").strip()})
    select s.item_id, s.rank, s.similar_id, s.score, i.title, i.main_category
    from s join v_items i on i.item_id = s.similar_id""")
def q_similar_items_api(spark, d):
    """The similar-items response shape - each neighbour with its product."""
    products = T.products(spark, d)
    sim = similarity.similar_items(products, T.item_vectors(spark, d), 10, "cosine")
    return sim.join(products.select(F.col("item_id").alias("similar_id"), "title", "main_category"),
                    "similar_id").select("item_id", "rank", "similar_id", "score", "title", "main_category")


@register("als_variant_b_metrics", "M2,M4,M5,M6,M7,A7", None)
def q_als_variant_b(spark, d):
    """Second training configuration: rank 50, reg 0.1, no nonnegativity."""
    model, udim, idim, train, test = _als(spark, d, "B")
    m = cf.regression_metrics(model.transform(test).na.drop())
    return m.select("rmse", "mae", F.col("n").alias("n_test"), F.lit(50).alias("rank"))
