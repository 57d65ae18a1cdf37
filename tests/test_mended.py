"""Inputs that once lost rows or switched behaviour."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from recolake import session
from recolake.functions import text as TX
from recolake.operators import activity, cf, documents, hybrid, ratelimit, ratings, search, similarity
from recolake.streaming import activity as S

T0 = dt.datetime(2024, 1, 1)


def ts(sec):
    return T0 + dt.timedelta(seconds=sec)


@pytest.mark.parametrize("compat", [False, True])
def test_rating_without_timestamp_stays(spark, compat):
    df = spark.createDataFrame([("u", "a", 4.0, None), ("u", "b", 3.0, ts(1)), ("u", "b", 2.0, None)],
                               "user_id string, item_id string, rating double, ts timestamp")
    got = {(r.item_id, r.rating) for r in ratings.prepare_ratings_first(df, compat=compat).collect()}
    assert got == {("a", 4.0), ("b", 3.0)}


def _fixture(spark):
    inter = spark.createDataFrame([(1, 10), (2, 11)], "user_id bigint, item_id bigint")
    uf = spark.createDataFrame([(1, [1.0, 0.0]), (2, [])], "user_id bigint, features array<float>")
    itf = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10, 14)], "item_id bigint, features array<float>")
    items = spark.createDataFrame([(i, f"t{i}", "HATS" if i % 2 else "SHOES", 4.0, i) for i in range(10, 14)],
                                  "item_id bigint, title string, main_category string, average_rating double, rating_number int")
    return spark.createDataFrame([(1,), (2,), (3,)], "user_id bigint"), inter, uf, itf, items


def test_user_with_an_empty_vector_gets_the_mix_of_the_given_category(spark):
    req, inter, uf, itf, items = _fixture(spark)
    got = hybrid.hybrid_recommendations(req, inter, uf, itf, items, 4, fallback_category="HATS").collect()
    mine = sorted((r.rank, r.item_id, r.source) for r in got if r.user_id == 2)
    assert [m[2] for m in mine] == ["popular", "popular", "category_hot", "category_hot"]
    assert {m[1] for m in mine[2:]} == {11, 13}
    classes = {r.user_id: (r.known, r.has_factor) for r in cf.user_classes(req, inter, uf).collect()}
    assert classes == {1: (True, True), 2: (True, False), 3: (False, False)}
    with pytest.raises(TypeError):
        hybrid.hybrid_recommendations(req, inter, uf, itf, items, 4)


def test_unknown_method_has_the_tables_id_types(spark):
    req, inter, uf, itf, items = _fixture(spark)
    texts = items.withColumn("item_id", F.col("item_id").cast("string"))
    empty = hybrid.recommend(req, "none", inter, uf, itf, texts)
    assert dict(empty.dtypes)["item_id"] == "string" and empty.count() == 0
    assert empty.unionByName(empty).count() == 0


def test_vectors_with_bad_components_count_as_missing(spark):
    items = spark.createDataFrame([Row(item_id=i, main_category="c") for i in range(1, 6)])
    nan, inf = float("nan"), float("inf")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0])],
                                 "item_id bigint, model_factor array<float>")
    got = sorted((r.rank, r.similar_id, r.score) for r in similarity.similar_items(items, vecs, 10).collect() if r.item_id == 1)
    assert [g[1] for g in got] == [2, 3, 4, 5] and [g[2] for g in got] == [2.0, 0.0, 0.0, 0.0]


def test_items_without_category_search_all_items(spark):
    items = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "item_id bigint, main_category string")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "item_id bigint, model_factor array<float>")
    got = {r.item_id: [] for r in items.collect()}
    for r in similarity.similar_items(items, vecs, 5).orderBy("rank").collect():
        got[r.item_id].append(r.similar_id)
    assert got == {1: [2, 3], 2: [], 3: []}


def test_missing_search_field_is_an_error(spark):
    docs = spark.createDataFrame([(1, "red ring")], "item_id bigint, title string")
    with pytest.raises(ValueError, match="no field"):
        search.search(docs, spark.createDataFrame([("red",)], "query string"))


def test_large_positions_in_user_names(spark):
    assert spark.range(1).select(TX.username(F.lit(3_000_000_000), F.lit("ABCDEFGHIJ"))).first()[0] == "user_3000000000_ABCDEFGH"


def test_updates_that_repeat_a_key_give_one_document(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "doc_id bigint, v string")
    got = documents.upsert(old, new).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3] and {r.v for r in got if r.doc_id == 2} <= {"c", "d"}


def test_null_keys_have_trailing_counts(spark):
    df = spark.createDataFrame([(None, ts(1)), (None, ts(2)), ("u", ts(2))], "k string, ts timestamp")
    got = sorted((r.k or "", r.trailing_count) for r in activity.trailing_counts(df, ["k"], "ts", 60).collect())
    assert got == [("", 1), ("", 2), ("u", 1)]


def brute_limit(rows, limit, window):
    out, held = {}, {}
    for i, user, action, t in sorted(rows, key=lambda r: (r[3], r[0])):
        if user is None:
            out[i] = (True, None)
            continue
        mine = [x for x in held.get((user, action), []) if x > t - window]
        ok = len(mine) < limit[action]
        out[i] = (ok, limit[action] - len(mine) - 1 if ok else 0)
        held[user, action] = mine + [t] if ok else mine
    return out


def limit_rows():
    r = np.random.default_rng(2)
    rows = [(i, "hot", str(r.choice(["search", "recommendations"])), int(t)) for i, t in enumerate(r.integers(0, 40_000, 1500))]
    rows += [(5000 + i, str(r.choice(["a", "b"])), "search", int(t)) for i, t in enumerate(r.integers(0, 9000, 200))]
    return rows + [(9000 + i, None, "search", i) for i in range(5)]


def requests(spark, rows):
    return spark.createDataFrame([(i, u, a, ts(t)) for i, u, a, t in rows], "event_id bigint, user_id string, action string, ts timestamp")


def test_limits_per_action_split_at_pauses(spark):
    rows = [r for r in limit_rows() if not (r[1] == "hot" and r[3] % 9000 > 3000)]  # pauses longer than the window
    limit = {"search": 5, "recommendations": 2}
    df = ratelimit.rate_limit(requests(spark, rows), ["user_id", "action"], "ts", limit, 600, "event_id")
    assert {r.event_id: (r.admitted, r.remaining) for r in df.collect()} == brute_limit(rows, limit, 600)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert df.filter("user_id = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_null_in_a_second_key_is_one_key(spark):
    rows = spark.createDataFrame([(i, "u", None, ts(i)) for i in range(5)], "event_id bigint, user_id string, action string, ts timestamp")
    got = [r.admitted for r in ratelimit.rate_limit(rows, ["user_id", "action"], "ts", 2, 600, "event_id").orderBy("event_id").collect()]
    assert got == [True, True, False, False, False]


def test_stream_admits_requests_without_user(spark, tmp_path):
    rows = limit_rows()
    requests(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests(spark, rows).schema).parquet(str(tmp_path / "in"))
    limit = {"search": 5, "recommendations": 2}
    got = S.run_available_now(S.rate_limit_stream(stream, ["user_id", "action"], limit, 600), "limit_test", "append")
    assert {r.event_id: (r.admitted, r.remaining) for r in got.collect()} == brute_limit(rows, limit, 600)


def test_events_in_a_folder_of_part_files_are_streamed(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    got = S.run_available_now(S.event_type_counts(S.file_events(spark, str(tmp_path))), "folder_test", "complete")
    assert got.agg(F.sum("n")).first()[0] > 0
    assert got.count() == S.run_available_now(
        S.event_type_counts(S.file_events(spark, "/root/testdata/sf0.001")), "file_test", "complete").count()


def test_stateful_operators_keep_string_ids(spark, tmp_path):
    rows = [(f"e{i:02}", "u", "B075" if i % 2 else None, "cat", ts(i)) for i in range(6)]
    schema = "event_id string, user_id string, item_id string, main_category string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    counts = S.idle_reset_counters(stream, "main_category", 3600, "ids_a")
    assert [(r.item_id, r.n) for r in counts.collect()] == [("B075", 3)]
    lists = S.recent_lists(stream, "user_id", 3600, "ids_b", 4)
    assert [(r.rank, r.event_id, r.item_id) for r in lists.orderBy("rank").collect()] == [
        (1, "e05", "B075"), (2, "e04", None), (3, "e03", "B075"), (4, "e02", None)]


def test_empty_streams_give_empty_results(spark, tmp_path):
    schema = "event_id bigint, user_id bigint, item_id bigint, ts timestamp"
    os.makedirs(tmp_path / "in")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert S.global_recent_list(stream, 10, 60, "empty_a").count() == 0
    assert S.global_idle_reset_counts(stream, "item_id", 60, "empty_b").count() == 0


def test_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_hit_rate_counts_first_requests_as_misses(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    r = ratelimit.hit_rate(ratelimit.first_requests(df, ["k"])).first()
    assert (r.hits, r.misses, r.hit_rate) == (1, 2, "33.33%")
    assert ratelimit.hit_rate(ratelimit.first_requests(df.limit(0), ["k"])).first().hit_rate == "0%"


def test_limiter_takes_the_keys_of_a_bucket_in_one_call(spark, tmp_path):
    """Large ids stay exact beside requests without a user, any number of buckets gives the same rows, state goes on over micro-batches."""
    import datetime as dt

    from recolake.streaming import activity as S
    big, start = 2 ** 60, dt.datetime(2024, 1, 1)
    rows = [(e, None if e % 10 == 0 else big + e % 7, "ab"[e % 2], start + dt.timedelta(seconds=37 * e)) for e in range(240)]
    for k in range(3):
        spark.createDataFrame(rows[80 * k:80 * k + 80], "event_id bigint, user_id bigint, action string, ts timestamp").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    got = {}
    for buckets in (1, 1024):
        stream = spark.readStream.schema("event_id bigint, user_id bigint, action string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(
            str(tmp_path / "in"))
        res = S.rate_limit_stream(stream, ["user_id", "action"], {"a": 1, "b": 2}, 900, buckets=buckets)
        got[buckets] = {(r.event_id, r.user_id, r.admitted, r.remaining) for r in S.run_available_now(res, "bucket_test", "append").collect()}
    want, held = set(), {}
    for e, u, a, t in rows:
        if u is None:
            want.add((e, u, True, None))
            continue
        limit, own = {"a": 1, "b": 2}[a], [x for x in held.get((u, a), []) if x > t - dt.timedelta(seconds=900)]
        ok = len(own) < limit
        held[u, a] = own + [t] if ok else own
        want.add((e, u, ok, limit - len(held[u, a]) if ok else 0))
    assert got[1] == want and got[1024] == want


def test_als_fit_cleans_its_shuffles(spark):
    """A checkpoint every second iteration; the model is that of a single one."""
    from recolake.operators import cf
    train = spark.createDataFrame([(u, i, float((u * i) % 5 + 1)) for u in range(12) for i in range(9) if (u + i) % 3],
                                  "user_idx int, item_idx int, rating double")
    model, plain = cf.fit_als(train, rank=3), cf.fit_als(train, rank=3, checkpoint_interval=10)
    assert model._java_obj.parent().getCheckpointInterval() == 2
    assert sorted(model.userFactors.collect()) == sorted(plain.userFactors.collect())


def test_als_blocks_follow_what_a_task_holds(spark):
    """The factors that a block's ratings name stay within the limit at any size; small fits keep Spark's ten blocks and their rows."""
    import math

    from recolake.operators import cf
    assert cf.als_blocks(0, 0, 0, 50) == cf.als_blocks(28_800_000, 900_000, 1_200_000, 50) == 10
    for ratings, users, items in ((172_800_000, 5_400_000, 7_200_000), (2_000_000_000, 50_000_000, 300_000), (10 ** 10, 1 << 31, 1 << 31)):
        blocks = cf.als_blocks(ratings, users, items, 50)
        for m in (users, items):
            assert m * -math.expm1(-ratings / blocks / m) * (4 * 50 + cf.ROW_BYTES) <= 1.001 * cf.BLOCK_BYTES
    assert 10 < cf.als_blocks(172_800_000, 5_400_000, 7_200_000, 50) < 40
    train = spark.createDataFrame([(u, i, float((u * i) % 5 + 1)) for u in range(60) for i in range(40) if (u + i) % 3],
                                  "user_idx int, item_idx int, rating double")
    model, plain = cf.fit_als(train, rank=3, max_iter=1, block_bytes=1300), cf.fit_als(train, rank=3, max_iter=1)
    used, kept = model._java_obj.parent(), plain._java_obj.parent()
    assert used.getNumUserBlocks() == used.getNumItemBlocks() > 10 and used.getIntermediateStorageLevel() == "DISK_ONLY"
    assert kept.getNumUserBlocks() == kept.getNumItemBlocks() == 10 and kept.getIntermediateStorageLevel() == "MEMORY_AND_DISK"
    assert model.userFactors.count() == 60 and model.itemFactors.count() == 40
