"""Exact, line and near deduplication against brute force and on edge cases."""

import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from recolake.llm import exact_dedup, line_dedup, ngram_join
from recolake.llm.common import shingle_sets
from recolake.llm.components import connected_components
from recolake.llm.cuckoo import CuckooFilter, build

from .conftest import rows_of


def hexed(t):
    return sha256((t or "").encode()).hexdigest()


def test_exact_groups_nulls_repeats_and_clashing_columns(spark, make):
    docs = make([(1, "a"), (5, "a"), (2, None), (3, ""), (4, "b "), (4, "b "), (None, "a"), (None, "only null")])
    docs = docs.withColumnsRenamed({"lang": "digest", "source": "keep_id"})
    got = sorted(rows_of(exact_dedup.exact_dedup(docs)), key=str)
    want = sorted([(1, 5, 3, False, hexed("a")), (5, 5, 3, True, hexed("a")), (None, 5, 3, False, hexed("a")),
                   (2, 3, 2, False, hexed("")), (3, 3, 2, True, hexed("")), (4, 4, 2, True, hexed("b ")),
                   (4, 4, 2, True, hexed("b ")), (None, None, 1, True, hexed("only null"))], key=str)
    assert got == want


def test_exact_empty_table(make):
    assert rows_of(exact_dedup.exact_dedup(make([]))) == []


def test_exact_hot_group_and_many_groups(make):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 900}") for i in range(3000)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = rows_of(exact_dedup.exact_dedup(make(rows)))
    assert sorted(got) == sorted((i, max(groups[t]), len(groups[t]), i == max(groups[t]), hexed(t)) for i, t in rows)


def test_index_persists_and_takes_only_new_digests(spark, make, tmp_path):
    path = str(tmp_path / "index")
    first = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.deduplicate(make([(1, "a"), (2, "b")]), first).collect()
    again = exact_dedup.DigestIndex(spark, path, 4)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(make([(7, "b"), (8, "c"), (9, "c")]), again).collect()}
    assert got == {7: (2, False), 8: (9, False), 9: (9, True)}
    assert sorted(r.keep_id for r in again.read().collect()) == [1, 2, 9]


def test_index_side_of_the_anti_join_is_not_shuffled(spark, make, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 8)
    index.add(exact_dedup.digests(make([(i, f"t{i}") for i in range(50)])))
    plan = (exact_dedup.digests(make([(1, "x")])).hint("merge").join(index.read(), "digest", "left_anti")
            ._jdf.queryExecution().executedPlan().toString())
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def brute_lines(rows, min_chars=40, min_docs=5):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < min_docs or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hexed("\n".join(kept))))
    return sorted(out)


LONG = "This line is at least forty characters long, number %d"


def line_rows():
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice(["short", "", "  " + LONG % r.randrange(12) + "\t", (LONG % r.randrange(12)).upper(),
                                    LONG % (100 + i)]) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    return [*rows, (100, None), (101, ""), (102, "\n\n"), (103, "é" * 39 + "\n" + "é" * 40),
            (104, (LONG % 3 + "\n") * 3000), (105, "x" * 300_000)]


def test_lines_against_brute_force(make):
    docs = make(line_rows()).withColumnsRenamed({"lang": "k1", "source": "lines"})
    got = rows_of(line_dedup.line_decisions(docs, line_dedup.new_index(docs, shards=4)))
    assert sorted(got) == brute_lines(line_rows())


def test_lines_without_filters_to_send(make, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", -1)
    docs = make(line_rows())
    assert sorted(rows_of(line_dedup.line_decisions(docs, line_dedup.new_index(docs, shards=4)))) == brute_lines(line_rows())


def test_lines_inserted_in_parts_and_deleted_again(spark, make, tmp_path):
    rows = line_rows()
    index = line_dedup.LineIndex(spark, str(tmp_path / "lines"), shards=4)
    index.insert(make(rows[:30]))
    index.insert(make(rows[30:]))
    assert sorted(rows_of(line_dedup.line_decisions(make(rows), index))) == brute_lines(rows)
    before = sorted(rows_of(index.counts()))
    index.insert(make([(1000 + i, LONG % i) for i in range(12)] * 5))
    index.delete(spark.range(1000, 1012).toDF("doc_id"))
    assert sorted(rows_of(index.counts())) == before
    gone = {i for i, _ in rows if i % 3 == 0}
    index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    left = [r for r in rows if r[0] not in gone]
    reopened = line_dedup.LineIndex(spark, str(tmp_path / "lines"), shards=4)
    assert sorted(rows_of(line_dedup.line_decisions(make(left), reopened))) == brute_lines(left)
    heavy = {(r.shard, r.k1) for r in reopened.counts().filter("n_docs >= 5").collect()}
    for f in reopened.filters().collect():
        held = CuckooFilter.load(f["filter"])
        assert (held.table > 0).sum() == sum(s == f.shard for s, _ in heavy)


def state(index):
    filters = {f.shard: int((CuckooFilter.load(f["filter"]).table > 0).sum()) for f in index.filters().collect()}
    return sorted(rows_of(index.refs()), key=str), sorted(rows_of(index.counts())), {s: n for s, n in filters.items() if n}


@pytest.mark.parametrize("compact", [3, 100])
def test_lines_grow_and_shrink_as_a_fresh_build(spark, make, tmp_path, monkeypatch, compact):
    monkeypatch.setattr(line_dedup, "COMPACT", compact)
    rows = line_rows()
    index = line_dedup.LineIndex(spark, str(tmp_path / "lines"), shards=4)
    for k in range(4):
        index.insert(make(rows[k::4]))
    index.delete(spark.createDataFrame([(i,) for i in range(0, 60, 2)] + [(None,)], "doc_id long"))
    index.insert(make([r for r in rows if r[0] in (0, 10, 20)]))  # deleted ids may come again
    left = [r for r in rows if r[0] in (0, 10, 20) or r[0] % 2 or r[0] >= 60]
    fresh = line_dedup.new_index(make(left), shards=4)
    assert state(index) == state(fresh)
    assert sorted(rows_of(line_dedup.line_decisions(make(left), index))) == brute_lines(left)
    # one more document writes no more than itself
    index.insert(make([(7000, LONG % 1 + "\n" + LONG % 2)]))
    last = f"{tmp_path}/lines/g{index.generation}"
    assert spark.read.parquet(f"{last}/refs").count() == spark.read.parquet(f"{last}/counts").count() == 2
    assert spark.read.parquet(f"{last}/filters").count() <= 2
    index.delete(spark.createDataFrame([(7000,)], "doc_id long"))
    assert state(index) == state(fresh)


def test_lines_empty_table_and_kept_texts(make):
    empty = make([])
    assert rows_of(line_dedup.line_decisions(empty, line_dedup.new_index(empty, shards=2))) == []
    docs = make([(i, f"{LONG % 1}\nown {i}") for i in range(5)] + [(9, None)])
    got = line_dedup.dedup_lines(docs, line_dedup.new_index(docs, shards=2))
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {
        **{i: f"own {i}" for i in range(4)}, 4: f"{LONG % 1}\nown 4", 9: None}


def test_cuckoo_insert_contains_delete():
    keys = np.random.default_rng(1).integers(-2**63, 2**63, 5000)
    f = build(keys)
    assert f.contains(keys).all()
    other = np.random.default_rng(2).integers(-2**63, 2**63, 20_000)
    assert f.contains(other).mean() < 0.002
    f.delete(keys[:4000])
    g = CuckooFilter.load(f.dump())
    assert g.contains(keys[4000:]).all() and (g.table > 0).sum() == 1000
    assert not CuckooFilter(8).insert(np.arange(500))


def brute_components(rows):
    def words(t):
        return (t or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").split()
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = [i for i, _ in rows]
    changed = True
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (c := len(sets[a] & sets[b])) and 100 * c >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return sorted((i, len(s), x) for (i, _), s, x in zip(rows, sets, label, strict=True))


def near_rows(n=150, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choices(vocabulary, k=60))
    rows, bases = [], [r.choices(vocabulary, k=r.randrange(4, 90)) for _ in range(20)]
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        text = " ".join(w)
        rows.append((r.randrange(10**9), r.choice([text, text.upper(), passage + " " + text, text.replace(" ", "\n", 3)])))
    return [*rows, (7, None), (8, ""), (9, " \t\n"), (10, "one two"), (11, "One  TWO"), (12, "one two three")]


def test_near_copies_against_brute_force(make):
    rows = near_rows()
    docs = make(rows).withColumnsRenamed({"lang": "digest", "source": "n"})
    assert sorted(rows_of(ngram_join.jaccard_components(docs))) == brute_components(rows)


def test_near_copies_in_cells(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "UNIT_SHINGLES", 300)
    rows = near_rows(80, 5)
    assert sorted(rows_of(ngram_join.jaccard_components(make(rows)))) == brute_components(rows)


def test_near_copies_order_by_frequency(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNT_BATCH", 500)
    monkeypatch.setattr(ngram_join, "COMMON", 50)
    rows = near_rows(100, 6)
    assert sorted(rows_of(ngram_join.jaccard_components(make(rows)))) == brute_components(rows)


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return [sum(1 for j, y in enumerate(sets) if i != j and x & y and 100 * len(x & y) >= 75 * len(x | y)) for i, x in enumerate(sets)]


@pytest.mark.parametrize("unit", [2_000_000, 300])
def test_numbers_of_links_against_brute_force(make, monkeypatch, unit):
    monkeypatch.setattr(ngram_join, "UNIT_SHINGLES", unit)
    rows = near_rows(200, 8)
    got = sorted(rows_of(ngram_join.jaccard_join(make(rows))))
    want = sorted((*x, n) for x, n in zip(sorted(brute_components(rows)), (n for _, n in sorted(zip((i for i, _ in rows), brute_links(rows), strict=True))), strict=True))
    assert got == want and max(n for *_, n in got) > 2


def test_near_copies_repeated_and_null_ids(make):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = rows_of(ngram_join.jaccard_components(make([(3, a), (3, b), (5, b), (9, a), (None, a), (None, "x y z"), (2, "q")])))
    assert sorted(got, key=str) == sorted([(3, 26, 3), (3, 26, 3), (5, 26, 3), (9, 26, 3), (None, 26, 3), (None, 1, None), (2, 1, 2)], key=str)


def test_near_copies_empty_table_and_one_of_each(make):
    assert rows_of(ngram_join.jaccard_components(make([]))) == []
    a = " ".join(f"a{i}" for i in range(60))
    docs = make([(1, a), (2, a + " end"), (3, "other words"), (4, None), (5, ""), (None, a), (6, a.upper())])
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, 3, 4, 5]
    # an id that different texts have ties nothing together, and no text is lost to it
    b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "bc")
    docs = make([(1, a), (1, b), (1, b + " end"), (1, b), (2, c), (1, c), (None, c), (None, a + " x"), (None, "own words of no id"), (None, "own words of no id"),
                 (1, None), (1, ""), (None, None)]).withColumnsRenamed({"lang": "digest", "source": "n"})
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    # of near copies under one id it is told by their digests which stays
    assert sorted((r.doc_id or 0, (r.text or "").removesuffix(" end")) for r in kept.collect()) == sorted(
        [(1, a), (1, b), (1, c), (0, "own words of no id"), (1, ""), (1, ""), (0, "")])


@pytest.mark.parametrize("seed", range(3))
def test_unit_links_connect_what_brute_force_connects(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**40, 200)
    sets = []
    for _ in range(120):
        b = base.copy()
        b[r.integers(0, 200, r.integers(1, 45))] = r.integers(0, 2**40, 1)
        sets.append(np.unique(b[r.integers(0, 30):]).astype(np.uint64))

    def components(links):
        label = list(range(len(sets)))
        for _ in range(len(sets)):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label
    every = [(a, b) for a in range(len(sets)) for b in range(a)
             if ngram_join.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))]
    found = ngram_join.unit_links(sets)
    assert {(max(x), min(x)) for x in found} <= set(every)
    assert components(found) == components(every)


def test_shingles_split_like_words():
    assert [len(s) for s in shingle_sets(["a b c d e", "A b  c\td e f", "a b", "", "\n"])] == [1, 2, 1, 0, 0]
    one, two = shingle_sets(["x a b c d e", "É a\x0bb c d E"])
    assert len(np.intersect1d(one, two)) == 1
    long = " ".join(f"w{i}" for i in range(400_000))
    assert len(shingle_sets([long, "a b c d e"])[0]) == 399_996


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 300)]
    got = dict(rows_of(connected_components(spark.createDataFrame(links, "a long, b long"))))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert rows_of(connected_components(spark.createDataFrame([], "a long, b long"))) == []
