"""Hand-made rows for the semantic traps and operator invariants."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from recolake.functions import text as TX
from recolake.functions import vectors as V
from recolake.operators import (activity, cf, documents, encode, hybrid, inventory, popular, ratelimit,
                                ratings, search, similarity, users)

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def ts(sec, us=0):
    return T0 + dt.timedelta(seconds=sec, microseconds=us)


def test_dedup_null_first_then_newest(spark):
    df = spark.createDataFrame([
        Row(user_id="u1", item_id="a", rating=4.0, ts=ts(10)),
        Row(user_id="u1", item_id="a", rating=None, ts=ts(20)),   # null duplicate
        Row(user_id="u1", item_id="b", rating=2.0, ts=ts(5)),
        Row(user_id="u1", item_id="b", rating=5.0, ts=ts(6)),
        Row(user_id=None, item_id="c", rating=3.0, ts=ts(1)),
    ], "user_id string, item_id string, rating double, ts timestamp")
    got = {(r.item_id, r.rating) for r in ratings.prepare_ratings_first(df).collect()}
    assert got == {("a", 4.0), ("b", 5.0)}
    # as coded: de-dup first keeps the newest row (null) and then drops it
    compat = {(r.item_id, r.rating) for r in ratings.prepare_ratings_first(df, compat=True).collect()}
    assert ("a", 4.0) not in compat
    mean = {(r.item_id, r.rating) for r in ratings.prepare_ratings_mean(df).collect()}
    assert mean == {("a", 4.0), ("b", 3.5)}


def test_dense_index_order_and_positions(spark):
    df = spark.createDataFrame([(x,) for x in "bbbaaccd"], "u string").repartition(3)
    got = {r.u: r.idx for r in encode.dense_index(df, "u").collect()}
    assert got == {"b": 0, "a": 1, "c": 2, "d": 3}
    pos = encode.row_positions(spark.range(0, 1000).repartition(7), [F.col("id")], "p")
    assert pos.filter(F.col("p") != F.col("id")).count() == 0


def test_hash_split_disjoint_complete_stable(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "k")
    a, b = ratings.hash_split(df, ["k"])
    assert a.count() + b.count() == 2000
    assert a.join(b, "k").count() == 0
    a2, _ = ratings.hash_split(df.repartition(5), ["k"])
    assert a.exceptAll(a2).count() == 0


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "rating double")
    h = ratings.rating_histogram(df).orderBy("bin").collect()
    assert len(h) == 10 and sum(r.n for r in h) == 2
    assert h[0].lo == pytest.approx(2.5) and h[-1].hi == pytest.approx(3.5)


def test_popular_missing_count_last_and_zero_score(spark):
    items = spark.createDataFrame([
        Row(item_id=1, rating_number=None), Row(item_id=2, rating_number=5), Row(item_id=3, rating_number=5)],
        "item_id bigint, rating_number bigint")
    got = [(r.item_id, r.score) for r in popular.popular_items(items, 3).orderBy("rank").collect()]
    assert got == [(2, 0.005), (3, 0.005), (1, 0.0)]


def test_blend_boost_guard(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 0.0), (1.0, 5.0)], "s double, a double")
    got = [r[0] for r in df.select(hybrid.blend("s", "a")).collect()]
    assert got == pytest.approx([0.6, 0.6, 1.0])


def _reco_fixture(spark):
    items = spark.createDataFrame([
        Row(item_id=i, title=f"t{i}", main_category="PROMO" if i % 2 else "X",
            average_rating=float(i % 5), rating_number=i) for i in range(1, 13)])
    inter = spark.createDataFrame([Row(user_id=1, item_id=1), Row(user_id=2, item_id=2)])
    uf = spark.createDataFrame([Row(user_id=1, features=[1.0, 0.0])], "user_id bigint, features array<float>")
    itf = spark.createDataFrame([Row(item_id=i, features=[float(i), 1.0]) for i in range(1, 13)],
                                "item_id bigint, features array<float>")
    req = spark.createDataFrame([Row(user_id=1), Row(user_id=2), Row(user_id=3)])
    return req, inter, uf, itf, items


def test_three_user_classes(spark):
    req, inter, uf, itf, items = _reco_fixture(spark)
    cfr = cf.collaborative_recommendations(req, inter, uf, itf, items, 3)
    by = {}
    for r in cfr.collect():
        by.setdefault(r.user_id, []).append(r)
    assert {r.source for r in by[1]} == {"cf"} and [r.item_id for r in sorted(by[1], key=lambda r: r.rank)] == [12, 11, 10]
    assert 2 not in by                                   # known, no factor -> empty
    assert {r.source for r in by[3]} == {"popular"}      # unknown -> popular
    hy = hybrid.hybrid_recommendations(req, inter, uf, itf, items, 4, fallback_category="PROMO")
    u2 = sorted([r for r in hy.collect() if r.user_id == 2], key=lambda r: r.rank)
    assert [r.source for r in u2] == ["popular", "popular", "category_hot", "category_hot"]
    assert all(r.main_category == "PROMO" for r in items.join(
        spark.createDataFrame([(r.item_id,) for r in u2[2:]], "item_id bigint"), "item_id").collect())


def test_hybrid_pads_short_lists_distinct(spark):
    req, inter, uf, itf, items = _reco_fixture(spark)
    few = items.filter(F.col("item_id").isin(12, 1, 2, 3))   # CF list 12..7: only 12 has a product
    hy = sorted([r for r in hybrid.hybrid_recommendations(req, inter, uf, itf, few, 3, fallback_category="PROMO").collect()
                 if r.user_id == 1], key=lambda r: r.rank)
    assert [(r.item_id, r.source) for r in hy] == [(12, "hybrid"), (3, "popular_pad"), (2, "popular_pad")]


def test_similar_items_zero_and_missing_vectors(spark):
    items = spark.createDataFrame([Row(item_id=i, main_category="c") for i in range(1, 6)])
    vecs = spark.createDataFrame([
        Row(item_id=1, model_factor=[1.0, 0.0]), Row(item_id=2, model_factor=[1.0, 0.0]),
        Row(item_id=3, model_factor=[0.0, 0.0]), Row(item_id=4, model_factor=[])],
        "item_id bigint, model_factor array<float>")
    got = similarity.similar_items(items, vecs, 10).collect()
    q1 = sorted([r for r in got if r.item_id == 1], key=lambda r: r.rank)
    assert [r.similar_id for r in q1] == [2, 3, 4, 5]
    assert [round(r.score, 6) for r in q1] == [2.0, 1.0, 0.0, 0.0]
    assert not [r for r in got if r.item_id in (4, 5)]   # no vector -> no query row


def test_cosine_and_logistic_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    r = df.select(V.cosine("a", "b").alias("c"), V.logistic_dot("a", "b").alias("l")).collect()
    assert r[0].c == pytest.approx(1.0) and r[1].c == 0.0 and r[1].l == pytest.approx(0.5)


def test_sessions_split_only_after_ttl(spark):
    df = spark.createDataFrame([
        Row(k="a", ts=ts(0)), Row(k="a", ts=ts(100)),            # gap exactly TTL: same session
        Row(k="a", ts=ts(200, 1)),                               # gap TTL + 1us: new session
        Row(k="a", ts=ts(50)),                                   # out of order
        Row(k="b", ts=ts(1000))])
    s = activity.with_session(df, ["k"], "ts", 100).collect()
    starts = sorted({(r.k, r.session_start) for r in s})
    assert starts == [("a", ts(0)), ("a", ts(200, 1)), ("b", ts(1000))]


def test_trailing_counts_window_edges(spark):
    df = spark.createDataFrame([Row(k=1, ts=ts(0)), Row(k=1, ts=ts(10)), Row(k=1, ts=ts(20)),
                                Row(k=1, ts=ts(20))])
    got = sorted(r.trailing_count for r in activity.trailing_counts(df, ["k"], "ts", 10).collect())
    assert got == [1, 1, 2, 2]                     # (t - 10, t]: the row 10 s earlier is out


def test_rate_limit_contract(spark):
    df = spark.createDataFrame([
        Row(id=1, u="x", ts=ts(0)), Row(id=2, u="x", ts=ts(0)), Row(id=3, u="x", ts=ts(0)),
        Row(id=4, u="x", ts=ts(3600)),                           # exactly window later: first two expired
        Row(id=5, u="x", ts=ts(3601)), Row(id=6, u="x", ts=ts(3602)),
        Row(id=7, u=None, ts=ts(1))], "id bigint, u string, ts timestamp")
    r = {x.id: (x.admitted, x.remaining, x.retry_after)
         for x in ratelimit.rate_limit(df, ["u"], "ts", 2, 3600, "id").collect()}
    assert r[1] == (True, 1, None) and r[2] == (True, 0, None) and r[3] == (False, 0, 3600)
    assert r[4][0] and r[5][0] and not r[6][0]
    assert r[7] == (True, None, None)


def test_format_and_key_helpers(spark):
    df = spark.createDataFrame([(512,), (16476,), (1024 ** 3,)], "b bigint")
    assert [r[0] for r in df.select(TX.format_bytes("b")).collect()] == ["512.00 B", "16.09 KB", "1.00 GB"]
    one = spark.range(1).select(TX.username(F.lit(7), F.lit("AG73BVBKXYZ")).alias("u"),
                                TX.key_part(F.lit("recs:u1:cf"), 1).alias("p"),
                                TX.percent_text(F.lit(1), F.lit(0)).alias("na")).first()
    assert (one.u, one.p, one.na) == ("user_007_AG73BVBK", "u1", "N/A")
    assert TX.glob_to_like("rec_s:*") == "rec\\_s:%"


def test_fuzzy_is_plain_levenshtein(spark):
    q = spark.createDataFrame([("hiar",), ("widgt",), ("ab",)], "qterm string")
    v = spark.createDataFrame([("hair",), ("widget",), ("ac",)], "term string")
    got = {(r.qterm, r.term, r.dist) for r in search.fuzzy_expansions(q, v).collect()}
    assert got == {("widgt", "widget", 1)}          # transposition = 2 edits > AUTO(4) = 1


def test_search_keyword_exact_and_best_field(spark):
    docs = spark.createDataFrame([Row(item_id=1, title="red ring", main_category="PROMO", store="B1"),
                                  Row(item_id=2, title="blue ring", main_category="SMALL", store="B2")])
    qs = spark.createDataFrame([("PROMO",), ("promo",), ("red",)], "query string")
    fields = (("title", 3.0, "text"), ("main_category", 2.0, "keyword"), ("store", 1.0, "keyword"))
    got = {(r.query, r.item_id) for r in search.search(docs, qs, 10, fields).collect()}
    assert ("PROMO", 1) in got and ("red", 1) in got
    assert ("promo", 1) not in got                  # keyword fields match the raw value only


def test_insert_users_first_wins(spark):
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "seq int, user_id string")
    existing = spark.createDataFrame([("c",)], "user_id string")
    r = {x.position: x for x in users.insert_users(batch, existing, [F.col("seq")]).collect()}
    assert [r[i].inserted for i in range(4)] == [True, True, False, False]
    assert r[1].username == "user_001_b" and r[1].email == "user_001_b@example.com"


def test_inventory_reports(spark):
    inv = spark.createDataFrame([
        Row(db="db0", key="recs:u1:cf", type="string", size_bytes=100, ttl_s=10),
        Row(db="db0", key="recs:u1:hybrid", type="string", size_bytes=0, ttl_s=-1),
        Row(db="db1", key="search:9", type="string", size_bytes=50, ttl_s=90000)])
    assert inventory.recommendation_cache(inv).first().asDict() == {
        "total_cached_recommendations": 2, "users_with_cache": 1}
    t = inventory.key_size_totals(inv, "recs:*").first()
    assert (t.total_bytes, t.total_keys) == (100, 1)
    e = inventory.expiry_buckets(inv).first()
    assert (e.total_expiring, e.expiring_within_1h, e.expiring_within_1d) == (2, 1, 1)


def test_upsert_last_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "doc_id int, v string, seq int")
    got = {(r.doc_id, r.v) for r in documents.upsert(old, new, "doc_id", "seq").collect()}
    assert got == {(1, "a"), (2, "y"), (3, "z")}


def test_json_sources_permissive(spark):
    from recolake.sources import files
    d = tempfile.mkdtemp(prefix="recolake-json-")
    p = os.path.join(d, "r.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"rating": 5.0, "asin": "A", "user_id": "u", "timestamp": 1700000000000,
                            "images": [{"large": "x"}]}) + "\n")
        f.write("{not json\n")
        f.write(json.dumps({"rating": "bad", "asin": "B"}) + "\n")
    rows = files.load_reviews(spark, p).collect()
    assert len(rows) == 3 and json.loads(rows[0].images[0]) == {"large": "x"}
    assert rows[1].asin is None and rows[2].rating is None
    ids = os.path.join(d, "ids.txt")
    with open(ids, "w") as f:
        f.write("  a1 \n\n b2\n   \nc3\n")
    got = [(r.position, r.user_id) for r in files.load_id_lines(spark, ids).orderBy("position").collect()]
    assert got == [(0, "a1"), (1, "b2"), (2, "c3")]
    with pytest.raises(Exception):
        files.load_reviews(spark, os.path.join(d, "missing.jsonl")).count()


def test_sink_counts_without_rescan(spark):
    from recolake.sinks import writers
    d = tempfile.mkdtemp(prefix="recolake-sink-")
    assert writers.overwrite_table(spark.range(123), os.path.join(d, "t")) == 123
    assert spark.read.parquet(os.path.join(d, "t")).count() == 123


def test_als_planted_low_rank(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    u, v = rng.uniform(0.2, 1.0, (60, 3)), rng.uniform(0.2, 1.0, (40, 3))
    rows = [(i, j, float(u[i] @ v[j] + rng.normal(0, 0.01))) for i in range(60) for j in range(40)]
    df = spark.createDataFrame(rows, "user_idx int, item_idx int, rating double")
    train, test = ratings.hash_split(df, ["user_idx", "item_idx"])
    model = cf.fit_als(train, rank=3, max_iter=15, reg_param=0.001)
    m = cf.regression_metrics(model.transform(test).na.drop()).first()
    std = df.agg(F.stddev("rating")).first()[0]
    assert m.rmse < 0.25 * std
    f = model.userFactors.select(F.explode("features").alias("x")).agg(F.min("x")).first()[0]
    assert f >= 0.0                                       # nonnegative by default
    pred = cf.predict_pairs(test.select(F.col("user_idx").alias("user_id"), F.col("item_idx").alias("item_id")),
                            model.userFactors.withColumnRenamed("id", "user_id"),
                            model.itemFactors.withColumnRenamed("id", "item_id"))
    t = model.transform(test).select(F.col("user_idx").alias("user_id"), F.col("item_idx").alias("item_id"),
                                     F.col("prediction").alias("p2"))
    diff = pred.join(t, ["user_id", "item_id"]).select(F.max(F.abs(F.col("prediction") - F.col("p2")))).first()[0]
    assert diff < 1e-4


def test_stream_rate_limit_equals_batch(spark):
    from recolake.plans.catalog import load_all
    reg = load_all()
    d = "/root/testdata/sf0.001"
    a = reg["stream_rate_limit_admission"].fn(spark, d)
    b = reg["rate_limit_admission"].fn(spark, d)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_image_urls_and_document_key(spark):
    df = spark.createDataFrame([
        Row(item_id="a", parent_asin="P", images=[Row(thumb="t1", large="l1", variant=None, hi_res=None),
                                                  Row(thumb="t2", large=None, variant=None, hi_res=None),
                                                  Row(thumb=None, large=None, variant="v", hi_res=None)]),
        Row(item_id="b", parent_asin=" ", images=[])],
        "item_id string, parent_asin string, images array<struct<thumb:string,large:string,variant:string,hi_res:string>>")
    vec = spark.createDataFrame([("a", [1.0], 1), ("a", [2.0], 2)], "item_id string, model_factor array<float>, model_timestamp bigint")
    docs = {r.item_id: r for r in documents.product_documents(df, vec, "item_id", "parent_asin").collect()}
    assert docs["a"].images == ["l1", "t2"] and docs["a"].doc_id == "P" and docs["a"].model_factor == [2.0]
    assert docs["b"].doc_id == "b" and docs["b"].model_factor is None


def test_clean_id_lines(spark):
    df = spark.createDataFrame([(" x ",), ("",), ("   ",), ("y",)], "value string")
    assert [r.user_id for r in users.clean_id_lines(df).collect()] == ["x", "y"]


def test_blocked_top_k_many_blocks_equals_one_block(spark):
    """The scale path (many hash blocks per group) gives the same answer as one block."""
    from recolake.sources import tables as T
    d = "/root/testdata/sf0.001"
    items, vecs = T.products(spark, d), T.item_vectors(spark, d)
    def rounded(df):  # matmul summation order differs with the block shape (last bits of the score)
        return df.withColumn("score", F.round("score", 9))
    one = rounded(similarity.similar_items(items, vecs, 10, block_size=100000))
    many = rounded(similarity.similar_items(items, vecs, 10, block_size=7))
    assert one.count() > 0 and one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    uf, itf = T.user_factors(spark, d), T.item_factors(spark, d)
    a = similarity.blocked_top_k(uf, itf, 5, q_id="user_id", q_vec="features", c_id="item_id",
                                 c_vec="features", metric="dot", block_size=100000)
    b = similarity.blocked_top_k(uf, itf, 5, q_id="user_id", q_vec="features", c_id="item_id",
                                 c_vec="features", metric="dot", block_size=16)
    a, b = rounded(a), rounded(b)
    assert a.count() == uf.count() * 5 and a.exceptAll(b).count() == 0


def test_stream_session_totals_and_late_data(spark):
    """ST4/ST10: session windows in the stream; sessions close (and are emitted) by the watermark."""
    import uuid
    from recolake.session import ensure_checkpoint_dir
    from recolake.streaming import activity as S
    base = os.path.join(ensure_checkpoint_dir(spark), f"late-{uuid.uuid4().hex[:8]}")
    schema = "k string, ts timestamp"
    spark.createDataFrame([("a", ts(0)), ("a", ts(60)), ("a", ts(10 * 3600))], schema) \
        .coalesce(1).write.parquet(os.path.join(base, "in", "f1"))          # one file = one batch
    spark.createDataFrame([("a", ts(120))], schema).coalesce(1) \
        .write.parquet(os.path.join(base, "in", "f2"))                      # late
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(os.path.join(base, "in")))
    # append mode: a session is emitted once the watermark passes its end (its state is
    # evicted); the open session waits. Spark guarantees on-time rows are counted; a row
    # older than the watermark may or may not be (documented Structured Streaming contract)
    out = S.run_available_now(S.session_totals(stream, ["k"], "1 hour"), "late", "append")
    got = sorted((r.session_start, r.n) for r in out.collect())
    assert [g[0] for g in got] == [ts(0)] and got[0][1] in (2, 3)


def test_rate_limit_hot_key_matches_brute_force(spark):
    """One key sending far above its limit (dense regime): the jump scan equals a plain greedy loop."""
    import numpy as np
    rng = np.random.default_rng(3)
    t = np.sort(rng.integers(0, 6 * 3600, 30000))
    rows = [(i, "hot" if i % 10 else "cold", ts(int(x))) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "id bigint, u string, ts timestamp")
    got = {r.id: r.admitted for r in ratelimit.rate_limit(df, ["u"], "ts", 50, 3600, "id").collect()}
    want = {}
    for key in ("hot", "cold"):
        adm = []
        for i, k, x in sorted(rows, key=lambda r: (r[2], r[0])):
            if k != key:
                continue
            live = [a for a in adm if a > x - dt.timedelta(seconds=3600)]
            want[i] = len(live) < 50
            if want[i]:
                adm = live + [x]
    assert got == want
    assert sum(got.values()) < 0.1 * len(rows)


def test_sql_functions(spark):
    from recolake.functions.sql import register_sql_functions
    register_sql_functions(spark)
    r = spark.sql("""select format_bytes(16476) as f, word_tokens('Red-Ring 42x') as t,
                            vec_cosine(array(cast(3 as float), 4), array(cast(6 as float), 8)) as c,
                            vec_logistic_dot(array(cast(1 as float)), array()) as l""").first()
    assert r.f == "16.09 KB" and r.t == ["red", "ring", "42x"] and r.c == pytest.approx(1.0) and r.l == 0.0


def test_jobs_end_to_end(spark):
    """M13 -> M12 -> search docs -> recommendations on hand-made JSON lines."""
    import random
    from recolake.plans import jobs
    d = tempfile.mkdtemp(prefix="recolake-jobs-")
    rnd = random.Random(5)
    with open(os.path.join(d, "reviews.jsonl"), "w") as f:
        for u in range(30):
            for a in rnd.sample(range(20), 8):
                f.write(json.dumps({"rating": float(1 + (u * a) % 5), "asin": f"A{a}", "parent_asin": f"A{a}",
                                    "user_id": f"U{u}", "timestamp": 1700000000000 + u * 1000 + a}) + "\n")
    with open(os.path.join(d, "meta.jsonl"), "w") as f:
        for a in range(20):
            f.write(json.dumps({"parent_asin": f"A{a}", "title": f"item {a}", "main_category": "PROMO",
                                "average_rating": 3.5, "rating_number": a,
                                "images": [{"thumb": "t", "large": None}]}) + "\n")
    counts = jobs.process_all(spark, os.path.join(d, "reviews.jsonl"), os.path.join(d, "meta.jsonl"),
                              os.path.join(d, "data"))
    assert counts["reviews"] == 240 and counts["products"] == 20 and counts["user_dim"] == 30
    m = jobs.train_and_save(spark, os.path.join(d, "data"), os.path.join(d, "model"), max_iter=3, rank=4)
    assert m["rmse"] > 0 and m["item_vectors"] > 0
    n = jobs.build_search_docs(spark, os.path.join(d, "data"), os.path.join(d, "model"), os.path.join(d, "docs"))
    assert n == 20
    users = spark.createDataFrame([("U1",), ("nobody",)], "user_id string")
    recs = jobs.recommend_job(spark, users, os.path.join(d, "data"), os.path.join(d, "model"), 5, fallback_category="PROMO").collect()
    assert {r.user_id for r in recs} == {"U1", "nobody"}
    assert {r.source for r in recs if r.user_id == "nobody"} <= {"hybrid", "popular_pad"}


def test_stream_global_counts_across_batches_equal_batch(spark):
    """ST7: three micro-batches (a session continues across batches, then an idle gap) = batch twin."""
    import uuid
    from recolake.session import ensure_checkpoint_dir
    from recolake.streaming import activity as S
    base = os.path.join(ensure_checkpoint_dir(spark), f"st7-{uuid.uuid4().hex[:8]}")
    schema = "ts timestamp, query string"
    parts = [[(ts(0), "a"), (ts(50), "b")], [(ts(90), "a"), (ts(150), "a")], [(ts(400), "b"), (ts(420), "a")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(base, "in", f"f{i}"))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(os.path.join(base, "in")))
    got = {(r.session_start, r.query, r.n) for r in S.global_idle_reset_counts(stream, "query", 100, "t").collect()}
    allrows = spark.createDataFrame([r for p in parts for r in p], schema)
    want = {(r.session_start, r.query, r.n) for r in activity.session_counts(allrows, [], "query", "ts", 100).collect()}
    assert got == want == {(ts(0), "a", 3), (ts(0), "b", 1), (ts(400), "b", 1), (ts(400), "a", 1)}


def test_stream_global_recent_list_across_batches(spark):
    """ST6: newest-2 list with a 100 s idle reset over three micro-batches = batch twin."""
    import uuid
    from recolake.session import ensure_checkpoint_dir
    from recolake.streaming import activity as S
    base = os.path.join(ensure_checkpoint_dir(spark), f"st6-{uuid.uuid4().hex[:8]}")
    schema = "event_id bigint, item_id bigint, ts timestamp"
    parts = [[(1, 10, ts(0)), (2, 11, ts(50))], [(3, 12, ts(90)), (4, 13, ts(150))], [(5, 14, ts(400))]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(base, "in", f"f{i}"))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(os.path.join(base, "in")))
    got = {(r.session_start, r.rank, r.event_id) for r in S.global_recent_list(stream, 2, 100, "t").collect()}
    allrows = spark.createDataFrame([r for p in parts for r in p], schema)
    s = activity.with_session(allrows, [], "ts", 100)
    want = {(r.session_start, r.rank, r.event_id) for r in popular.top_k_per_key(
        s, ["session_start"], [F.col("ts").desc(), F.col("event_id").desc()], 2).collect()}
    assert got == want == {(ts(0), 1, 4), (ts(0), 2, 3), (ts(400), 1, 5)}


def test_trailing_counts_hot_burst_and_prefix_sum(spark):
    """A burst of one key inside one window (the case a per-(key, bucket) window
    partition cannot split) equals brute force; prefix sums cross partitions."""
    import numpy as np
    rng = np.random.default_rng(11)
    t = rng.integers(0, 600, 3000)
    rows = [(i, "hot" if i % 7 else "x", ts(int(x))) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "id bigint, k string, ts timestamp").repartition(6)
    got = {r.id: r.trailing_count for r in activity.trailing_counts(df, ["k"], "ts", 120).collect()}
    by = {}
    for i, k, x in rows:
        by.setdefault(k, []).append(x)
    want = {i: sum(1 for y in by[k] if x - dt.timedelta(seconds=120) < y <= x) for i, k, x in rows}
    assert got == want
    ps = encode.prefix_sum(spark.range(0, 5000, 1, 9).withColumn("v", F.lit(2.0)), [F.col("id")], "v", "c")
    assert ps.filter(F.col("c") != (F.col("id") + 1) * 2).count() == 0


def test_bucketed_tables_join_without_shuffle(spark):
    import uuid
    from recolake.session import ensure_checkpoint_dir
    from recolake.sinks import writers
    base = os.path.join(ensure_checkpoint_dir(spark), f"bucketed-{uuid.uuid4().hex[:8]}")
    a = spark.range(0, 1000).select((F.col("id") % 50).alias("user_id"), F.col("id").alias("x"))
    b = spark.range(0, 50).select(F.col("id").alias("user_id"), (F.col("id") * 2).alias("y"))
    suffix = uuid.uuid4().hex[:6]
    writers.write_bucketed(a, f"fact_{suffix}", ["user_id"], 4, path=os.path.join(base, "a"))
    writers.write_bucketed(b, f"dim_{suffix}", ["user_id"], 4, path=os.path.join(base, "b"))
    with_bc = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table(f"fact_{suffix}").join(spark.table(f"dim_{suffix}"), "user_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and j.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_bc)


def test_sinks_and_metrics_roundtrip(spark):
    import uuid
    from recolake.session import ensure_checkpoint_dir
    from recolake.sinks import writers
    from recolake.sources import files
    base = os.path.join(ensure_checkpoint_dir(spark), f"sinks-{uuid.uuid4().hex[:8]}")
    vec = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "item_id bigint, model_factor array<float>")
    writers.export_vectors_json(vec, os.path.join(base, "vec_json"))                       # K4
    assert {r.asin for r in spark.read.json(os.path.join(base, "vec_json")).collect()} == {1, 2}
    assert writers.append_table(vec, os.path.join(base, "app")) == 2                        # K2
    assert writers.append_table(vec, os.path.join(base, "app")) == 2
    assert spark.read.parquet(os.path.join(base, "app")).count() == 4
    writers.write_vector_index(vec, os.path.join(base, "vidx"), buckets=4)                  # K7
    assert spark.read.parquet(os.path.join(base, "vidx")).select("bucket").distinct().count() >= 1
    dim = spark.createDataFrame([("u2", 1), ("u1", 0), ("u3", 2)], "user_id string, idx bigint")
    writers.export_dimension(dim, os.path.join(base, "dim"))                                # K5
    writers.write_first_labels(dim, os.path.join(base, "first"), 2)                         # K11
    assert sorted(r.value for r in spark.read.text(os.path.join(base, "first")).collect()) == ["u1", "u2"]
    writers.write_metrics(spark, {"rmse": 0.5, "mae": 0.1, "model_version": "v1", "rank": 25,
                                  "max_iter": 10, "reg_param": 0.01}, os.path.join(base, "metrics"))  # K9
    m = files.load_metrics(spark, os.path.join(base, "metrics")).first()                    # S9
    assert (m.rmse, m.rank, m.model_version) == (0.5, 25, "v1")


def test_exclude_seen_and_dispatch(spark):
    req, inter, uf, itf, items = _reco_fixture(spark)
    seen = spark.createDataFrame([(1, 12), (1, 11)], "user_id bigint, item_id bigint")
    r = cf.collaborative_recommendations(req, inter, uf, itf, items, 3, exclude_seen=seen)
    u1 = [x.item_id for x in sorted([x for x in r.collect() if x.user_id == 1], key=lambda x: x.rank)]
    assert u1 == [10, 9, 8]
    assert hybrid.recommend(req, "other", inter, uf, itf, items, 3).count() == 0
    assert hybrid.recommend(req, "cf", inter, uf, itf, items, 3).filter("user_id = 1").count() == 3


def test_stable_query_hash(spark):
    a = spark.createDataFrame([("hair spray",)], "q string").select(TX.stable_hash("q")).first()[0]
    b = spark.createDataFrame([("hair spray",)], "q string").repartition(3).select(TX.stable_hash("q")).first()[0]
    assert a == b and isinstance(a, int)


def test_regex_search_is_literal_and_safe(spark):
    docs = spark.createDataFrame([Row(item_id=1, title="Hair (Spray) x.y"), Row(item_id=2, title="xzy hair")])
    qs = spark.createDataFrame([("hair (spray",), ("x.y",), ("HAIR",)], "query string")
    got = {(r.query, r.item_id) for r in search.regex_search(docs, qs).collect()}
    assert got == {("hair (spray", 1), ("x.y", 1), ("HAIR", 1), ("HAIR", 2)}


def test_encode_keep_invalid_and_label_lookup(spark):
    r = spark.createDataFrame([("u1", "a", 5.0), ("u9", "a", 3.0), (None, "b", 1.0)],
                              "user_id string, item_id string, rating double")
    udim = spark.createDataFrame([("u1", 0), ("u2", 1)], "user_id string, idx bigint")
    idim = spark.createDataFrame([("a", 0), ("b", 1)], "item_id string, idx bigint")
    kept = {(x.user_id, x.user_idx) for x in encode.encode_ratings(r, udim, idim, keep_invalid=True).collect()}
    assert kept == {("u1", 0), ("u9", 2), (None, 2)}          # unseen and null -> len(labels)
    inner = encode.encode_ratings(r, udim, idim).collect()
    assert [(x.user_id, x.item_idx) for x in inner] == [("u1", 0)]
    recs = spark.createDataFrame([(0, 0.9), (1, 0.8), (2, 0.7)], "item_idx bigint, score double")
    got = {(x.item_id, x.score) for x in encode.labels_to_items(recs, idim, "item_idx", "item_id").collect()}
    assert got == {("a", 0.9), ("b", 0.8)}                   # out-of-dictionary index 2 dropped


def test_hybrid_bag_padding_as_coded(spark):
    """distinct_pad=False keeps the reference's bag behaviour: pads may repeat listed items."""
    req, inter, uf, itf, items = _reco_fixture(spark)
    few = items.filter(F.col("item_id").isin(12, 1, 2, 3))
    hy = sorted([r for r in hybrid.hybrid_recommendations(req, inter, uf, itf, few, 3, fallback_category="PROMO", distinct_pad=False)
                 .collect() if r.user_id == 1], key=lambda r: r.rank)
    assert [(r.item_id, r.source) for r in hy] == [(12, "hybrid"), (12, "popular_pad"), (3, "popular_pad")]


def test_search_array_fields_and_best_field(spark):
    """Text fields may be arrays (features, description); the document score is
    the best boosted field, not the sum over fields."""
    docs = spark.createDataFrame([
        Row(item_id=1, title="plain box", main_category="X", store="S",
            features=["red glossy finish"], description=["a red box"]),
        Row(item_id=2, title="red red box", main_category="X", store="S", features=[], description=[])],
        "item_id bigint, title string, main_category string, store string, "
        "features array<string>, description array<string>")
    qs = spark.createDataFrame([("red",)], "query string")
    res = {r.item_id: r.score for r in search.search(docs, qs, 10, fuzzy=False).collect()}
    assert set(res) == {1, 2}
    t_only = {r.item_id: r.score for r in search.search(
        docs, qs, 10, fields=(("title", 3.0, "text"),), fuzzy=False).collect()}
    f_only = {r.item_id: r.score for r in search.search(
        docs, qs, 10, fields=(("features", 2.0, "text"),), fuzzy=False).collect()}
    d_only = {r.item_id: r.score for r in search.search(
        docs, qs, 10, fields=(("description", 1.0, "text"),), fuzzy=False).collect()}
    assert res[2] == pytest.approx(t_only[2])
    assert res[1] == pytest.approx(max(f_only[1], d_only[1]))


def test_fixed2_is_half_up_on_the_binary_value(spark):
    df = spark.createDataFrame([(1.125,), (2.675,), (0.0,), (99.999,), (1152.0 / 1024,)], "x double")
    got = [r[0] for r in df.select(TX.fixed2("x")).collect()]
    assert got == ["1.13", "2.68", "0.00", "100.00", "1.13"]       # 2.675 * 100 rounds to 267.5 in IEEE
