"""Classifiers, nearest neighbours, license scans and mixing."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recolake.llm import ann, language_id, license_scan, mixing, quality

from .conftest import rows_of


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


LANGS = {"aa": ["the", "and", "of", "with", "have", "house"], "bb": ["und", "der", "nicht", "schön", "über", "ein"],
         "cc": ["что", "это", "как", "дом", "она", "нет"]}


def lang_rows(n=240):
    r = random.Random(5)
    return [(i, " ".join(r.choices(LANGS[lang], k=r.randrange(3, 40))), lang) for i, lang in zip(range(n), itertools.cycle(LANGS), strict=False)]


def test_language_accuracy_and_edges(make):
    rows = lang_rows()
    extra = [(1000, None, "aa"), (1001, "12 34 !!", "aa"), (1002, "", None), (1003, "und der nicht", None), (1003, "und der nicht", None),
             (None, "the house and", "aa"), (1004, "house the " * 40_000, "aa"), (1005, "X", "aa")]
    docs = make(rows + extra).withColumnRenamed("source", "_language")
    got = language_id.language_predictions(docs).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: lang for i, _, lang in rows}
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    judged = [r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth and r.held_out]
    assert len(judged) > 20 and np.mean(judged) > 0.97
    other = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id not in truth}
    assert all(other[i] == ("und", 0.0) for i in (1000, 1001, 1002))
    assert other[1003][0] == "bb" and other[None][0] == "aa" and other[1004][0] == "aa" and other[1005][0] in LANGS
    kept = language_id.identified(docs)
    assert kept.columns == docs.columns
    assert {1000, 1001, 1002}.isdisjoint(r.doc_id for r in kept.collect())


def test_language_never_learns_from_held_out_or_unlabelled_rows(make):
    rows = [(i, t, "zz" if held_out(i) else lang) for i, t, lang in lang_rows()]
    assert {r.lang_pred for r in language_id.language_predictions(make(rows)).collect()} == set(LANGS)
    assert {r.lang_pred for r in language_id.language_predictions(make([(1, "word", None)])).collect()} == {"und"}
    assert rows_of(language_id.language_predictions(make([]))) == []


def test_collapsed_weights_equal_the_kernel_by_way_of_landmarks():
    rows = lang_rows(90)
    grams = [language_id.present(t) for _, t, _ in rows]
    model = language_id.fit_sample([x for *_, x in rows], grams, landmarks=12)
    # the same by definition: kernel with landmarks, Nystrom map, ridge weights
    turn = {}
    order = sorted((turn.setdefault(x, []).append(0) or len(turn[x]), x, i) for i, (*_, x) in enumerate(rows))
    marks = [i for *_, i in order[:12]]

    def kernel(a, b):
        return len(np.intersect1d(grams[a], grams[b])) / np.sqrt(len(grams[a]) * len(grams[b]))
    kll = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(kll)
    keep = values > 1e-6 * values.max()
    phi = np.array([[kernel(a, b) for b in marks] for a in range(len(rows))]) @ (vectors[:, keep] / np.sqrt(values[keep]))
    y = np.where(np.array([x for *_, x in rows])[:, None] == np.array(sorted(LANGS))[None, :], 1.0, -1.0)
    c, m = phi.mean(axis=0), y.mean(axis=0)
    w = np.linalg.solve((phi - c).T @ (phi - c) + language_id.RIDGE * len(rows) * np.eye(phi.shape[1]), (phi - c).T @ (y - m))
    assert np.allclose(model.margins([t for _, t, _ in rows]), (phi - c) @ w + m, atol=1e-3)


def quality_rows():
    r = random.Random(8)
    vocabulary = [f"wort{i}" for i in range(800)]
    rows, labels = [], []
    for i in range(400):
        w = r.choices(vocabulary, k=r.randrange(20, 120))
        bad = i % 4 == 0
        if bad:
            w = r.choice([[x.upper() + "!!" for x in w], w[:2] * 30, [x + " |" for x in w]])
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(not bad)))
    return rows, labels


def test_quality_accuracy_and_edges(spark, make):
    rows, labels = quality_rows()
    extra = [(1000, None), (1001, ""), (1001, ""), (1002, "a" * 500_000), (None, "no id here")]
    table = spark.createDataFrame([*labels, (1000, None), (3, labels[3][1]), (77_777, 1), (None, 1)], "doc_id long, quality int")
    got = quality.quality_scores(make(rows + extra).withColumnsRenamed({"lang": "x", "source": "score"}), table).collect()
    assert len(got) == len(rows) + len(extra)
    truth = dict(labels)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == held_out(r.doc_id) for r in got)
    judged = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth and r.held_out]
    assert len(judged) > 40 and np.mean(judged) > 0.95


def test_quality_without_labels_or_rows(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.quality_scores(make([(1, "a b"), (2, None)]), none).collect()] == [0.5, 0.5]
    assert rows_of(quality.quality_scores(make([]), none)) == []


def test_discriminant_equals_the_density_ratio(spark):
    r = np.random.default_rng(0)
    d = len(quality.STATISTICS)
    x = np.concatenate([r.normal(0, 1, (300, d)), r.normal(0.7, 2, (500, d))])
    y = [0] * 300 + [1] * 500
    model = quality.fit(spark.createDataFrame([(a.tolist(), b) for a, b in zip(x, y, strict=True)], "x array<double>, y int"))
    scale = np.sqrt(sum(n * np.cov(a.T, bias=True) for n, a in ((300, x[:300]), (500, x[300:]))).diagonal() / 800)
    own = [x[:300] / scale, x[300:] / scale]
    centred = [a - a.mean(axis=0) for a in own]
    cov = [np.cov(a.T, bias=True) for a in own]
    pooled = (300 * cov[0] + 500 * cov[1]) / 800
    ball = np.eye(d) * np.trace(pooled) / d
    # Ledoit and Wolf by definition: the mean squared error of the rows' own products over the distance from the target
    noise = np.mean([((np.outer(v, v) - pooled) ** 2).sum() for v in np.concatenate(centred)]) / 800
    share = max(quality.LEAST_SHRINKAGE, min(1, noise / ((pooled - ball) ** 2).sum()))
    target = (1 - share) * pooled + share * ball

    def density(v, c):
        n = len(own[c])
        s = (n * cov[c] + d * target) / (n + d)
        z = v / scale - own[c].mean(axis=0)
        return -0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) - 0.5 * np.linalg.slogdet(s)[1]
    logit = np.log(500 / 300) + density(x, 1) - density(x, 0)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-logit)))


def brute_neighbours(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v)
            and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, a in good:
        if q % 50 == 0:
            s = sorted((-(a @ b) / np.sqrt(a @ a) / np.sqrt(b @ b), i) for i, b in good if i != q and len(b) == len(a))
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [100_000, 400])
def test_neighbours_recall_ties_and_bad_vectors(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(ann, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(ann, "GROUP_ROWS", 20)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=24).astype("f4").tolist()) for i in range(1600)]
    rows += [(2000 + i, rows[50][1]) for i in range(40)]  # ties with query 50
    nan, inf = float("nan"), float("inf")
    rows += [(3000, None), (3050, [0.0] * 24), (3100, [nan] + [1.0] * 23), (3150, [inf] + [1.0] * 23), (3200, [None] + [1.0] * 23),
             (None, [1.0] * 24), (3250, [1.0, 2.0]), (3251, [2.0, 4.0]), (3300, [])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for x in ann.nearest(table, table.filter("vec_id % 50 = 0")).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = (x.vec_id, x.score)
    want = brute_neighbours(rows)
    assert got.keys() == want.keys()
    assert [got[50][i][0] for i in range(1, 6)] == [2000, 2001, 2050, 2100, 2150][:2] + [2002, 2003, 2004]
    assert got[3250] == {1: (3251, pytest.approx(1.0))}
    hits = [len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9
    exact = {(q, i): s for q in want for i, s in brute_neighbours([x for x in rows], 10**6)[q]} if shard_rows == 400 else {}
    assert all(abs(s - exact[q, v]) < 1e-12 for q in got for v, s in got[q].values() if exact)


def test_neighbours_of_few_rows_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, -1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r.vec_id) for r in ann.nearest(table, table.filter("vec_id = 0")).collect())
    assert got == [(1, 1), (2, 2)]
    assert rows_of(ann.nearest(table.limit(0), table.limit(0))) == []


def brute_licenses(rows):
    import re
    word = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

    def grams(t):
        w = word.findall((t or "").lower())
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    out = set()
    for i, t in rows:
        g = set(grams(t))
        for name, texts in license_scan.NOTICES.items():
            for n, x in enumerate(texts):
                if len(g & set(grams(x))) == len(set(grams(x))):
                    out.add((i, f"{name}/{n}"))
    return out


def test_licenses_against_brute_force(spark, make):
    r = random.Random(9)
    notices = [x for texts in license_scan.NOTICES.values() for x in texts]
    rows = []
    for i in range(120):
        w = [f"word{r.randrange(300)}" for _ in range(r.randrange(0, 200))]
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            w.insert(r.randrange(len(w) + 1), r.choice(notices).upper())
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "MIT License"), (503, "filler " * 60_000 + notices[0])]
    docs = make(rows).withColumnsRenamed({"lang": "license", "source": "s"})
    got = license_scan.scan(docs, license_scan.templates(spark)).collect()
    assert {(x.doc_id, x.template_id) for x in got if x.containment == 1.0} == brute_licenses(rows)
    at = {x.doc_id: x.first_word for x in got}
    assert at[503] == 60_000
    assert rows_of(license_scan.scan(make([]), license_scan.templates(spark))) == []


def test_licenses_partial_and_native(spark, make):
    w = license_scan.NOTICES["MIT"][1].split()
    changed = " ".join([*w[:-4], "something", "else", "stands", "here"])
    cut = " ".join(w[:12])
    df = license_scan.scan(make([(1, "x " * 50 + changed + " y" * 50), (2, cut)]), license_scan.templates(spark))
    got = {(x.doc_id, x.template_id): x.containment for x in df.collect()}
    assert set(got) == {(1, "MIT/1")} and 0.75 <= got[1, "MIT/1"] < 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        license_scan.scan(make([]), license_scan.templates(spark, {"x": ["too few words"]}))


def test_licenses_short_notices_and_kindred_licenses(spark, make):
    rows = [(1, "x y. ALL rights, reserved"), (2, "All rights reserved. " * 3), (3, "all rights are reserved"), (4, "ISC license"), (5, "licensed"),
            (6, "w " * 9000 + "// SPDX-License-Identifier: BSD-2-Clause"), (7, "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), (8, None), (9, "")]
    gnu = "This library is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    kinds = [("", "2", "GPL-2.0"), ("", "3", "GPL-3.0"), ("Lesser ", "2.1", "LGPL-2.1"), ("Lesser ", "3", "LGPL-3.0"), ("Affero ", "3", "AGPL-3.0")]
    rows += [(10 + i, gnu.format(kind, version)) for i, (kind, version, _) in enumerate(kinds)]
    cc = ["", "-ShareAlike", "-NoDerivatives", "-NonCommercial", "-NonCommercial-ShareAlike", "-NonCommercial-NoDerivatives"]
    rows += [(20 + i, f"This work is licensed under a Creative Commons Attribution{x} 4.0 International License.") for i, x in enumerate(cc)]
    found = license_scan.scan(make(rows), license_scan.templates(spark), short=license_scan.short_templates(spark))
    got = {}
    for x in found.collect():
        got.setdefault(x.doc_id, []).append((x.license, x.containment, x.first_word, x.n_windows))
    reserved = "LicenseRef-All-Rights-Reserved"
    assert {i: x for i, x in got.items() if i < 7} == {1: [(reserved, 1.0, 2, 1)], 2: [(reserved, 1.0, 0, 3)], 4: [("ISC", 1.0, 0, 1)], 6: [("BSD-2-Clause", 1.0, 9000, 1)]}
    assert {i: {n for n, *_ in x} for i, x in got.items() if i >= 7} == {
        7: {"GPL-2.0"}, **{10 + i: {name} for i, (*_, name) in enumerate(kinds)},
        **{20 + i: {name} for i, name in enumerate(["CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"])}}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_every_notice_is_found_under_its_own_license_only(spark, make):
    texts = [(name, x) for d in (license_scan.NOTICES, license_scan.SHORT_NOTICES) for name, xs in d.items() for x in xs]
    found = license_scan.scan(make([(i, x) for i, (_, x) in enumerate(texts)]), license_scan.templates(spark), short=license_scan.short_templates(spark))
    assert {(x.doc_id, x.license) for x in found.collect()} == {(i, name) for i, (name, _) in enumerate(texts)}


def test_quotas_fill_by_weight_and_stop_at_the_repeats():
    assert mixing.quotas({}) == {}
    got = mixing.quotas({"a": 1, "b": 100, "c": 100, None: 99})
    assert got["a"] == 3.0 and sum(got.values()) == pytest.approx(300)
    assert got["b"] / got["c"] == pytest.approx(2) and got[None] / got["b"] == pytest.approx(2.5)
    assert mixing.quotas({"a": 0, "b": 10}) == {"a": 0.0, "b": 10.0}


def cost(patterns, flow):
    total = 0
    for (_, n), f in zip(patterns, flow, strict=True):
        words = sum(f.values())
        for k in range(3):
            total += k * min(n, max(0, words - k * n))
    return total


def test_flow_is_the_cheapest_of_all_by_enumeration():
    r = random.Random(0)
    for _ in range(25):
        patterns = [(("a",), r.randrange(1, 4)), (("a", "b"), r.randrange(1, 4)), (("b",), r.randrange(0, 3))]
        quota = {"a": r.randrange(0, 8), "b": r.randrange(0, 8)}
        flow = mixing.min_cost_flow(patterns, quota)
        caps = [3 * n for _, n in patterns]
        best = None
        for x, y, z, t in itertools.product(range(caps[0] + 1), range(caps[1] + 1), range(caps[1] + 1), range(caps[2] + 1)):
            if y + z <= caps[1] and x + y <= quota["a"] and z + t <= quota["b"]:
                f = [{"a": x}, {"a": y, "b": z}, {"b": t}]
                key = (-(x + y + z + t), cost(patterns, f))
                best = key if best is None else min(best, key)
        assert (-sum(sum(f.values()) for f in flow), cost(patterns, flow)) == best


def mix_rows():
    r = random.Random(6)
    return [(i, " ".join(["w"] * r.choice([1, 5, 20, 60])), "en", r.choice(["a", "a", "a", "b", "Z", None])) for i in range(900)]


def test_mix_comes_near_its_targets_and_agrees_on_reruns(make):
    rows = mix_rows() + [(5000, None, "en", "a"), (5001, "", "en", "c"), (None, "w w", "en", "b"), (5002, "w " * 9, "en", "b"),
                         (5002, "w " * 9, "en", "b"), (6000, "w " * 30, "en", "tiny")]
    docs = make(rows).withColumnsRenamed({"lang": "size", "n_chars": "target"})
    first = mixing.mix_decisions(docs).collect()
    assert sorted(map(str, first)) == sorted(map(str, mixing.mix_decisions(docs.repartition(7)).collect()))
    assert len(first) == len(rows)
    sizes, taken, target = {}, {}, {}
    source = {}
    for i, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
        source[i] = s
    want = mixing.quotas(sizes)
    for r in first:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
    assert all(abs(taken[s] - target[s]) <= max(2, 0.02 * target[s]) for s in taken if s != "tiny"), (taken, target)
    assert taken["tiny"] == 90 and taken["c"] == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(taken.values())


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i < 50 else ["b", "a", "b"] if i < 80 else ["b"] if i < 95 else []) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    plan, per_source = mixing.plan_mix(docs)
    assert {tuple(r.pattern): r.base for r in plan.collect()}[()] == 0
    assert {r.source: r.source_size for r in per_source.collect()} == {"a": 800, "b": 450}
    got = mixing.mixed(docs).groupBy(F.array_sort(F.array_distinct("source")).alias("s")).count().collect()
    assert sum(r["count"] for r in got) == pytest.approx(100, abs=2) and () not in {tuple(r.s) for r in got}


def test_mix_near_targets_with_null_and_repeated_ids(make):
    r = random.Random(3)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"{i} " + "w " * r.choice([1, 4, 9]), "en", "abc"[i % 7 % 3]) for i in range(3000)]
    got = mixing.mix_decisions(make(rows)).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, taken = mixing.quotas(sizes), {}
    for x in got:
        taken[round(x.target, 6)] = taken.get(round(x.target, 6), 0) + x.taken
    assert taken.keys() == {round(v, 6) for v in want.values()}
    assert all(abs(t - n) <= max(10, 0.01 * t) for t, n in taken.items()), taken


def test_mix_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 5)
    n = 3000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("source"))
    got = mixing.mix_decisions(docs).collect()
    want = mixing.quotas({f"s{i:05}": 3 for i in range(n)})
    assert len(got) == n and all(x.target == pytest.approx(want[f"s{x.doc_id:05}"]) and abs(x.taken - x.target) <= 3 for x in got)
    two = docs.withColumn("source", F.array("source", F.lit("all")))
    with pytest.raises(ValueError, match="overlap"):
        mixing.mixed(two)


def test_overlapping_query_against_the_flow(spark):
    rows = [(i, "w " * (5 + i % 7), ["lang:en" if i % 3 else "lang:de", "source:a" if i % 2 else "source:b"]) for i in range(400)]
    got = mixing.mix_overlapping(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    patterns = {}
    for _, t, m in rows:
        patterns[tuple(sorted(m))] = patterns.get(tuple(sorted(m)), 0) + len(t.split())
    sizes = {}
    for m, size in patterns.items():
        for s in m:
            sizes[s] = sizes.get(s, 0) + size
    quota = mixing.quotas(sizes, total=sum(patterns.values()))
    flow = mixing.min_cost_flow(sorted(patterns.items()), quota)
    taken = {}
    for x in got:
        taken[tuple(x.sources)] = taken.get(tuple(x.sources), 0) + x.taken
        assert x.source_size == sum(sizes[s] for s in x.sources) and x.target == pytest.approx(sum(quota[s] for s in x.sources))
    for (m, _), f in zip(sorted(patterns.items()), flow, strict=True):
        assert abs(taken[m] - sum(f.values())) <= 6


def test_three_hundred_languages():
    r = random.Random(2)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:03}": ["".join(r.choices(alphabet, k=5)) for _ in range(8)] for k in range(300)}
    train = [(lang, " ".join(r.choices(w, k=30))) for lang, w in words.items() for _ in range(6)]
    model = language_id.fit_sample([lang for lang, _ in train], [language_id.present(t) for _, t in train])
    assert len(model.languages) == 300 and model.weights.shape[1] <= 2 * 300
    test = [(lang, " ".join(r.choices(w, k=30))) for lang, w in words.items()]
    got, _ = model.predict([t for _, t in test])
    assert np.mean([a == b for a, (b, _) in zip(got, test, strict=True)]) > 0.95


def test_rare_languages_are_learned(make, monkeypatch):
    monkeypatch.setattr(language_id, "SALTS", 3)
    rows = lang_rows() + [(5000 + i, " ".join(["zug", "quax", "yorn"] * 6), "rare") for i in range(4)]
    got = language_id.language_predictions(make(rows)).collect()
    assert {r.lang_pred for r in got if r.doc_id >= 5000} == {"rare"}


def test_mix_of_nothing(make):
    assert rows_of(mixing.mix_decisions(make([]))) == []
    assert rows_of(mixing.mixed(make([]))) == []
