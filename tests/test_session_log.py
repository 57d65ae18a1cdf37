"""Mergeable session state: late rows, replayed epochs, restarts, expiry; and the two sinks of event ingestion."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from recolake.operators import activity as batch
from recolake.operators.popular import top_k_per_key
from recolake.streaming import activity as S
from recolake.streaming.session_log import SessionLog

SCHEMA = "event_id bigint, k string, item_id bigint, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def rows_at(seconds, seed=0):
    r = random.Random(seed)
    return [(i, r.choice(["a", "b", None]), r.randrange(3), T0 + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)]


def some_rows(n=400):
    r = random.Random(7)
    return rows_at([r.choice([0, 500, 2000, 2600, 9000]) + r.random() * 400 for _ in range(n)])


def counts_of(df):
    return sorted((r.k or "", r.session_start, r.item_id, r.n) for r in df.collect())


def expected_counts(spark, rows, ttl):
    named = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.coalesce("k", F.lit("")))
    return sorted((r.k, r.session_start, r.item_id, r.n) for r in batch.session_counts(named, ["k"], "item_id", "ts", ttl).collect())


def folder(spark, tmp_path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in os.listdir(tmp_path / "in"):  # the source takes files by their age
            path = tmp_path / "in" / f
            if f.endswith(".parquet") and not os.path.exists(f"{path}.seen"):
                os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
                open(f"{path}.seen", "w").close()
    for f in os.listdir(tmp_path / "in"):
        if f.endswith(".seen"):
            os.unlink(tmp_path / "in" / f)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("compact_every", [2, 20])
def test_late_rows_bridge_sessions(spark, tmp_path, compact_every):
    """Rows in any order over five micro-batches give the batch result; a late row joins two sessions that stood apart."""
    rows = some_rows()
    random.Random(1).shuffle(rows)
    stream = folder(spark, tmp_path, [rows[k::5] for k in range(5)])
    log = SessionLog(str(tmp_path / "log"), ["k"], 300, member="item_id", compact_every=compact_every)
    log.start(stream).awaitTermination()
    assert counts_of(log.sessions(spark)) == expected_counts(spark, rows, 300)
    two = SessionLog(str(tmp_path / "two"), [], 100, member="item_id")
    two.write(spark.createDataFrame(rows_at([0, 150]), SCHEMA), 0)
    assert two.sessions(spark).select("session_start").distinct().count() == 2
    two.write(spark.createDataFrame(rows_at([75]), SCHEMA), 1)
    assert {r.session_start for r in two.sessions(spark).collect()} == {T0}


def test_a_replayed_epoch_counts_once(spark, tmp_path):
    rows = some_rows(60)
    log = SessionLog(str(tmp_path / "log"), ["k"], 300, member="item_id", compact_every=2)
    for epoch, part in enumerate((rows[:20], rows[20:40], rows[40:])):
        df = spark.createDataFrame(part, SCHEMA)
        log.write(df, epoch)
        log.write(df, epoch)
    assert counts_of(log.sessions(spark)) == expected_counts(spark, rows, 300)


def test_a_restarted_query_goes_on(spark, tmp_path):
    rows = some_rows(90)
    log = SessionLog(str(tmp_path / "log"), ["k"], 300, newest=3, columns=["event_id", "ts"], compact_every=2)
    got = None
    for k in range(3):  # each run is a query of its own, started after the one before has ended
        stream = folder(spark, tmp_path, [rows[k::3]])
        SessionLog(**log.__dict__).start(stream).awaitTermination()
        got = log.sessions(spark)
    assert log._numbered(spark, "delta") == [0, 1, 2] and log._numbered(spark, "base") == [1]
    named = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.coalesce("k", F.lit("")))
    want = top_k_per_key(batch.with_session(named, ["k"], "ts", 300), ["k", "session_start"], [F.col("ts").desc(), F.col("event_id").desc()], 3)
    assert sorted((r.k or "", r.session_start, r.rank, r.event_id) for r in got.collect()) == sorted(
        (r.k, r.session_start, r.rank, r.event_id) for r in want.collect())


def test_state_is_empty_after_expiry_and_too_late_rows_are_left_out(spark, tmp_path):
    log = SessionLog(str(tmp_path / "log"), ["k"], 100, member="item_id", lateness_seconds=1000, compact_every=1)
    early, later = rows_at([0, 50, 90]), rows_at([5000, 5050])
    log.write(spark.createDataFrame(early, SCHEMA), 0)
    log.write(spark.createDataFrame(later, SCHEMA), 1)
    # accepted: within the lateness; left out: before the horizon that the second epoch set
    log.write(spark.createDataFrame(rows_at([4500, 60]), SCHEMA), 2)
    log.compact(spark, 2)
    state = spark.read.parquet(f"{log.path}/base/2")
    assert state.agg(F.min("first_us")).first()[0] >= (T0 + dt.timedelta(seconds=4500)).timestamp() * 1e6 - 1e9
    starts = {r.session_start for r in log.sessions(spark).filter("k is not null or true").collect()}
    want = expected_counts(spark, early + later + rows_at([4500]), 100)
    assert starts == {w[1] for w in want} and sum(r.n for r in log.sessions(spark).collect()) == 6
    log.write(spark.createDataFrame(rows_at([99_000]), SCHEMA), 3)
    log.compact(spark, 3)
    assert spark.read.parquet(f"{log.path}/base/3").count() == 1
    assert sum(r.n for r in log.sessions(spark).collect()) == 7


def test_rate_limit_state_expires_and_null_users_have_none(spark, tmp_path):
    schema = "event_id bigint, user_id bigint, action string, ts timestamp"

    def at(i, user, s):
        return (i, user, "search", T0 + dt.timedelta(seconds=s))
    first = [at(i, i % 4 or None, i) for i in range(200)]
    for k, rows in enumerate((first, [at(900, 9, 20_000)], [at(901, None, 90_000)], [at(902, None, 90_001)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    res = S.rate_limit_stream(stream, ["user_id", "action"], 5, 600, watermark="10 minutes")
    q = (res.writeStream.outputMode("append").foreachBatch(lambda b, e: b.write.mode("append").parquet(str(tmp_path / "out")))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 203 and sum(r.admitted for r in out if r.user_id in (1, 2, 3)) == 15
    assert all(r.admitted and r.remaining is None for r in out if r.user_id is None)
    state = spark.read.format("statestore").load(str(tmp_path / "cp"))
    assert state.count() == 0


def test_ingest_has_two_sinks_in_one_epoch(spark, tmp_path):
    lines = ['{"event_id": 1, "event_type": "search", "user_id": "u", "timestamp": "2024-01-01T00:00:00.5", "query": "x"}',
             '{"event_type": "product_view", "asin": "B1", "more": 1}', '{"event_id": 3}', "no json", "", '{"event_type": "search"', "[1]"]
    os.makedirs(tmp_path / "in")
    for k in range(3):
        with open(tmp_path / "in" / f"{k}.txt", "w") as f:
            f.write("\n".join(lines) + "\n")
    path = str(tmp_path / "out")
    for _ in range(2):  # nothing new: the second run adds nothing
        S.ingest(S.text_events(spark, str(tmp_path / "in")), path).awaitTermination()
    good, bad = S.ingested(spark, path)
    assert sorted((r.event_id or 0, r.event_type, r.asin) for r in good.collect()) == sorted([(1, "search", None), (0, "product_view", "B1")] * 3)
    assert good.filter("event_id = 1").first().ts == dt.datetime(2024, 1, 1, 0, 0, 0, 500_000)
    assert sorted(r.raw for r in bad.collect()) == sorted(lines[2:] * 3)
    parsed, rejected = S.parse_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert parsed.count() == 2 and sorted(r._raw for r in rejected.collect()) == sorted(lines[2:])
    back = S.to_event_json(parsed.drop("ts")).collect()
    assert S.parse_events(spark.createDataFrame(back))[0].drop("ts").collect() == parsed.drop("ts").collect()
    typed = {(r.event_id, r.item_id) for r in S.typed_activity(parsed).collect()}
    assert typed == {(1, None), (None, None)}
