"""The document store, the one-pass report, page projections, and the portable split hash."""

import datetime as dt
import hashlib
import os
import random

from pyspark.sql import functions as F

from recolake.operators import activity, document_store, documents, inventory, ratings
from recolake.session import scratch_folder

WRITES = "doc_id string, seq bigint, v string, deleted boolean"


def latest(writes):
    best = {}
    for k, s, v, gone in writes:
        if k is not None and s is not None and (k not in best or s > best[k][0]):
            best[k] = (s, v, bool(gone))
    return sorted((k, s, v) for k, (s, v, gone) in best.items() if not gone)


def test_document_store_keeps_the_last_write(spark):
    r = random.Random(1)
    seqs = r.sample(range(5000), 600)
    writes = [(f"d{r.randrange(80)}", s, f"v{s}", r.random() < 0.2) for s in seqs] + [(None, 1, "x", False), ("d1", None, "x", None)]
    r.shuffle(writes)
    store = document_store.DocumentStore(scratch_folder(spark, "store-test"), buckets=4)
    assert store.read(spark) is None and store.merge(spark.createDataFrame([], WRITES)) == []
    for k in range(4):
        store.merge(spark.createDataFrame(writes[k::4], WRITES))
        if k == 1:  # a replayed batch changes nothing
            store.merge(spark.createDataFrame(writes[k::4], WRITES))
    rows = sorted((x.doc_id, x.seq, x.v) for x in store.read(spark).collect())
    assert rows == latest(writes)
    assert store.read(spark, tombstones=True).count() > len(rows)


def test_document_store_rewrites_only_touched_buckets(spark):
    store = document_store.DocumentStore(scratch_folder(spark, "store-test"), buckets=8)
    first = store.merge(spark.createDataFrame([(f"d{i}", 1, "a", False) for i in range(100)], WRITES))
    before = store._last(spark)
    touched = store.merge(spark.createDataFrame([("d5", 2, "b", False)], WRITES))
    after = store._last(spark)
    assert len(touched) == 1 and sorted(first) == list(range(8))
    assert {b for b in after if after[b] != before[b]} == set(touched)
    # a batch with a further column, one without it, and a late write behind a deletion
    store.merge(spark.createDataFrame([("d6", 3, "c", True, 9)], WRITES + ", w int"))
    store.merge(spark.createDataFrame([("d6", 2, "late", False)], WRITES))
    got = {x.doc_id: x.v for x in store.read(spark).collect()}
    assert "d6" not in got and got["d5"] == "b" and len(got) == 99


def test_upsert_is_the_same_on_every_run(spark):
    old = spark.createDataFrame([(1, "a")], "doc_id int, v string")
    new = spark.createDataFrame([(1, v) for v in "bdc"] + [(2, "x")], "doc_id int, v string")
    for parts in (1, 3):
        assert {(r.doc_id, r.v) for r in documents.upsert(old, new.repartition(parts)).collect()} == {(1, "d"), (2, "x")}


def test_report_of_separate_tables(spark):
    keys = [("db0", "recs:u1:cf", "string", 2048, 10), ("db0", "recs:u1:hybrid", "string", 0, -1), ("db1", "search:9", "string", 50, 90_000), ("db1", "x", "zset", None, None)]
    inv = spark.createDataFrame(keys, "db string, key string, type string, size_bytes bigint, ttl_s bigint")
    events = [("product_view", i % 13) for i in range(40)] + [("purchase", 3), ("search", 5), ("product_view", None)]
    log = inventory.report_log(inv, spark.createDataFrame(events, "event_type string, item_id bigint"))
    hit = spark.createDataFrame([(3, 1, "75.00%")], "hits bigint, misses bigint, hit_rate string")
    got = {}
    for r in inventory.inventory_report(log, hit).collect():
        got.setdefault(r.section, {})[r.metric] = r.value
    assert got["key_sizes"] == {"total_bytes": "2098", "total_size": "2.05 KB", "total_keys": "2"}
    assert got["expiry"] == {"total_expiring": "2", "expiring_within_1h": "1", "expiring_within_1d": "1"}
    assert got["recommendation_cache"] == {"total_cached_recommendations": "2", "users_with_cache": "1"}
    assert got["key_types"] == {"string": "3", "zset": "1", "type_count": "2", "total": "4"}
    assert got["expires_per_db"] == {"db0": "1", "db1": "1", "total": "2"} and got["avg_ttl_per_db"] == {"db0": "10", "db1": "90000", "total": "45005"}
    assert got["top_viewed"] == {"0": "4", **{str(i): "3" for i in range(12, 3, -1)}} and got["top_purchased"] == {"3": "1"}
    assert got["trending"] == {"total_viewed_products": "13", "total_purchased_products": "1"} and got["performance"]["hit_rate"] == "75.00%"
    empty = {(r.section, r.metric): r.value for r in inventory.inventory_report(log.limit(0)).collect()}
    assert empty["key_sizes", "total_bytes"] == "0" and empty["avg_ttl_per_db", "total"] is None


def test_product_page(spark):
    rows = [(1, "t" * 70, "d" * 200, list("abcd"), list("fghijk"), 4.256), (2, None, None, None, None, None)]
    items = spark.createDataFrame(rows, "item_id int, title string, description string, descriptions array<string>, features array<string>, score double")
    one, two = documents.product_page(items).orderBy("item_id").collect()
    assert (one.short_title, one.short_text, one.descriptions, one.features, one.score) == ("t" * 60, "d" * 150, list("abc"), list("fghij"), "4.26")
    assert two.asDict() == {"item_id": 2, "short_title": None, "short_text": None, "descriptions": None, "features": None, "score": None}
    assert documents.product_page(items.select("item_id", "title")).columns == ["item_id", "short_title"]


def test_split_hash_is_that_of_any_engine(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 678)
    rows = [(i, f"k{i}" if i % 5 else None, at) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b string, ts timestamp")
    us = int((at - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000 + at.microsecond
    want = {a: hashlib.md5(f"42|{a}|{b or ''}|{us}".encode()).hexdigest() for a, b, _ in rows}
    assert {r.a: r.h for r in df.select("a", ratings.key_hash(df, ["a", "b", "ts"]).alias("h")).collect()} == want
    train, _ = ratings.hash_split(df, ["a", "b", "ts"])
    assert {r.a for r in train.collect()} == {a for a, h in want.items() if int(h[:8], 16) % 10000 < 8000}
    lowest = sorted(want, key=want.get)[:7]
    for parts in (1, 6):
        assert {r.a for r in ratings.hash_sample(df.repartition(parts), ["a", "b", "ts"], 7).collect()} == set(lowest)


def test_stage_counts_with_nulls(spark):
    rows = [(1, 1, 5.0), (1, 1, None), (1, None, 3.0), (None, 2, 1.0), (2, 1, 4.0), (2, 3, None)]
    got = ratings.stage_counts(spark.createDataFrame(rows, "user_id int, item_id int, rating double")).first()
    assert tuple(got) == (6, 2, 2, 2, 1)
    none = ratings.stage_counts(spark.createDataFrame([], "user_id int, item_id int, rating double")).first()
    assert tuple(none) == (0, 0, 0, 0, 0)


def test_session_ends(spark):
    rows = spark.createDataFrame([(i, 0, 100 * i, 100 * i + 50) for i in (0, 1, 3)], "_b long, k int, _bmin long, _bmax long")
    got = sorted((r._b, r.session_start_us, r.session_end_us) for r in activity.sessions_of_buckets(rows, ["k"], 1).collect())
    assert got == [(0, 0, 150), (1, 0, 150), (3, 300, 350)]
    assert os.path.isabs(scratch_folder(spark, "x").removeprefix("file:")) and F is not None


def test_raw_json_and_tables(spark, tmp_path):
    from recolake.sources import files
    with open(tmp_path / "raw.jsonl", "w") as f:
        f.write('{"a": 1, "b": {"c": "x"}}\n{"a": 2, "d": [1]}\n')
    raw = files.load_raw_json(spark, str(tmp_path / "raw.jsonl"))
    assert {(r.a, r.b and r.b.c) for r in raw.collect()} == {(1, "x"), (2, None)}
    raw.select("a").write.csv(str(tmp_path / "csv"), header=True)
    assert sorted(r.a for r in files.load_table(spark, str(tmp_path / "csv"), "csv", header=True, inferSchema=True).collect()) == [1, 2]
    raw.select("a").createOrReplaceTempView("raw_numbers")
    assert files.load_table(spark, "raw_numbers", "table").count() == 2
