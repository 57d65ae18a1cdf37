"""The stored search index and the pigeonhole join against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from recolake.operators import fuzzy, search, search_index
from recolake.plans import jobs
from recolake.session import scratch_folder


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def auto(q):
    return 0 if len(q) <= 2 else 1 if len(q) <= 5 else 2


def test_pigeonhole_join_against_brute_force(spark):
    r = random.Random(1)
    words = sorted({"".join(r.choices("abcé", k=r.randrange(1, 10))) for _ in range(400)})
    asked = sorted(set(r.sample(words, 40)) | {"".join(r.choices("abcé", k=k)) for k in range(1, 12) for _ in range(4)})
    long = "".join(r.choices("abcdefgh", k=2000))
    words += [long, long[:700] + long[701:], long[:3] + "zz" + long[5:], long[:1000] + "zzz" + long[1003:]]
    asked.append(long)
    got = {(x.qterm, x.term, x.dist) for x in fuzzy.fuzzy_expansions(
        spark.createDataFrame([(q,) for q in asked], "qterm string"), spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    want = {(q, w, d) for q in asked for w in words if abs(len(q) - len(w)) <= 2 and (d := edits(q, w)) <= auto(q)}
    assert got == want and len({w for q, w, _ in got if q == long}) == 3
    # keys do not grow with the length of a term
    keys = fuzzy.query_keys(spark.createDataFrame([(long,)], "qterm string")).count()
    assert keys <= 75 and fuzzy.vocabulary_keys(spark.createDataFrame([(long,)], "term string")).count() == 5


def tok(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_search(docs, queries, num, fields, fuzz):
    best = {}
    for field, boost, kind in fields:
        values = {d["item_id"]: d[field] for d in docs}
        if kind == "keyword":
            held = {i: v for i, v in values.items() if v is not None}
            for q in queries:
                hits = [i for i, v in held.items() if v == q]
                for i in hits:
                    s = math.log(1 + (len(held) - len(hits) + 0.5) / (len(hits) + 0.5)) * boost
                    best[q, i] = max(best.get((q, i), 0), s)
            continue
        t = {i: tok(" ".join(v) if isinstance(v, list) else v) for i, v in values.items()}
        t = {i: x for i, x in t.items() if x}
        if not t:
            continue
        mean, df = sum(map(len, t.values())) / len(t), Counter(w for x in t.values() for w in set(x))
        for q in queries:
            for i, x in t.items():
                total, tf = 0.0, Counter(x)
                for w in tok(q):
                    near = [(v, edits(w, v)) for v in tf if abs(len(v) - len(w)) <= 2] if fuzz else [(w, 0)] if w in tf else []
                    total += max(((1 - d / min(len(w), len(v))) * math.log(1 + (len(t) - df[v] + 0.5) / (df[v] + 0.5))
                                  * tf[v] * 2.2 / (tf[v] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for v, d in near if d <= auto(w)), default=0)
                if total:
                    best[q, i] = max(best.get((q, i), 0), total * boost)
    out = []
    for q in queries:
        rows = sorted(((-round(s, 9), i) for (p, i), s in best.items() if p == q and s > 0))[:num]
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(rows)]
    return sorted(out)


SCHEMA = "item_id bigint, title string, main_category string, store string, features array<string>, description string"


@pytest.fixture(scope="module")
def collection():
    r = random.Random(4)
    words = ["red", "ring", "ringe", "widget", "widgets", "box", "cold", "colder", "of", "a", "größe"]
    docs = [{"item_id": i, "title": " ".join(r.choices(words, k=r.randrange(0, 4))), "main_category": r.choice(["SMALL", "PROMO", None]),
             "store": r.choice(["B1", "red"]), "features": r.choice([None, [], ["Red-box", "a widgt"], [" ".join(r.choices(words, k=4))]]),
             "description": r.choice([None, "", " ".join(r.choices(words, k=r.randrange(1, 60)))])} for i in range(300)]
    docs += [{"item_id": 1000 + i, "title": "cold ring", "main_category": "SMALL", "store": "B9", "features": None, "description": "box " * 5000} for i in range(40)]
    return docs


QUERIES = ["red ring", "colde", "PROMO", "promo", "widgte box", "zzzz", "", "a of a", "größe", "red", "box"]


@pytest.mark.parametrize(("block", "fuzz", "fields"), [(7, True, search.SEARCH_AND_RECOMMEND_FIELDS), (50, False, search.SEARCH_PRODUCTS_FIELDS),
                                                       (1024, True, search.SEARCH_AND_RECOMMEND_FIELDS)])
def test_block_max_equals_scoring_everything(spark, collection, block, fuzz, fields):
    docs = spark.createDataFrame([tuple(d.values()) for d in collection], SCHEMA).repartition(3)
    path = search_index.build_index(docs, scratch_folder(spark, "index-test"), fields, block_docs=block, buckets=3)
    asked = spark.createDataFrame([(q,) for q in [*QUERIES, "red", None]], "query string")
    report = {}
    got = search_index.search_index(spark, path, asked, 5, fields, fuzz, report)
    got = sorted((r.query, r.rank, r.item_id, r.score) for r in got.collect())
    want = brute_search(collection, QUERIES, 5, fields, fuzz)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, want, strict=True))
    if block == 7:  # blocks whose bound cannot reach the answer are never scored
        assert report["scored"] < 0.75 * report["pairs"]


def test_index_of_nothing_and_string_ids(spark):
    fields = (("title", 1.0, "text"), ("store", 1.0, "keyword"))
    none = spark.createDataFrame([], "item_id string, title string, store string")
    asked = spark.createDataFrame([("red",)], "query string")
    assert search.search(none, asked, 5, fields).collect() == []
    docs = spark.createDataFrame([("b", "red ring", None), ("a", "red ring", "red"), ("c", None, None)], none.schema)
    assert [(r.rank, r.item_id) for r in search.search(docs, asked, 5, fields).orderBy("rank").collect()] == [(1, "a"), (2, "b")]


def test_index_and_query_jobs(spark, tmp_path):
    docs = spark.createDataFrame([("P1", "red ring", "c", None, ["x"], ["a fine ring"]), ("P2", "blue", "c", "s", None, None)],
                                 "doc_id string, title string, main_category string, store string, features array<string>, description array<string>")
    docs.write.parquet(str(tmp_path / "docs"))
    jobs.build_search_index(spark, str(tmp_path / "docs"), str(tmp_path / "index"))
    asked = spark.createDataFrame([("rinf",), ("blue",)], "query string")
    got = sorted((r.query, r.item_id) for r in jobs.search_job(spark, str(tmp_path / "index"), asked).collect())
    assert got == [("blue", "P2"), ("rinf", "P1")]
    assert [r.query for r in jobs.search_job(spark, str(tmp_path / "index"), asked, fuzzy=False).collect()] == ["blue"]


def test_only_postings_that_are_asked_for_are_met(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"red word{i}") for i in range(300)], "item_id bigint, title string")
    fields, seen = (("title", 1.0, "text"),), []
    path = search_index.build_index(docs, str(tmp_path / "index"), fields, block_docs=50)
    plain = search_index.block_bounds
    monkeypatch.setattr(search_index, "block_bounds", lambda postings, asked: seen.append(postings) or plain(postings, asked))
    asked = spark.createDataFrame([("red word7",)], "query string")
    got = search_index.search_index(spark, path, asked, 2, fields, fuzzy=False).collect()
    assert [r.item_id for r in sorted(got, key=lambda r: r["rank"])] == [7, 0]
    assert {r.term for r in seen[0].select("term").distinct().collect()} == {"red", "word7"}
