"""Blocked top-k with exact skipping against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recolake.operators import similarity


def score(metric, q, c):
    d = q @ c.T
    if metric == "cosine":
        nq, nc = np.linalg.norm(q, axis=1, keepdims=True), np.linalg.norm(c, axis=1)
        return np.divide(d, nq * nc, out=np.zeros_like(d), where=(nq * nc) > 0) + 1
    return 1 / (1 + np.exp(-d)) if metric == "logistic" else d


def brute(metric, q, c, k, same):
    s = score(metric, q, c)
    out = set()
    for i in range(len(q)):
        rows = sorted((-round(s[i, j], 9), j) for j in range(len(c)) if not (same and i == j))
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(rows[:k])}
    return out


def vectors(seed, n, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 16))
    x = centres[r.integers(0, 6, n)] + spread * r.normal(size=(n, 16))
    x *= r.lognormal(0, 1.2, n)[:, None]
    x[5] = 0
    x[40:60] = x[40]  # ties
    return x


def frame(spark, x, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} bigint, vec array<double>").repartition(3)


@pytest.mark.parametrize("metric", ["cosine", "dot", "logistic"])
@pytest.mark.parametrize("block", [13, 100_000])
def test_blocks_and_skipping_are_exact(spark, metric, block):
    c, q = vectors(1, 700, 0.05), vectors(2, 120, 0.05)
    report = {}
    got = similarity.blocked_top_k(frame(spark, q, "u"), frame(spark, c, "i"), 4, q_id="u", q_vec="vec", c_id="i", c_vec="vec", metric=metric,
                                   block_size=block, report=report)
    assert {(r.qid, r.cid, r["rank"]) for r in got.collect()} == brute(metric, q, c, 4, False)
    # 13 rows a part: 54 parts of candidates
    assert report["pairs"] == len(q) * len(c) and report["scored"] <= report["pairs"]


@pytest.mark.parametrize(("metric", "most"), [("cosine", 0.7), ("dot", 0.7)])
def test_skipped_share_in_a_task(metric, most):
    c, q = vectors(3, 6000, 0.05), vectors(4, 300, 0.05)
    if metric == "cosine":
        unit = [np.divide(x, n, out=np.zeros_like(x), where=n > 0) for x in (c, q) for n in [np.linalg.norm(x, axis=1, keepdims=True)]]
        c, q = unit
    k = np.full(len(q), 5)
    i, j, s, scored = similarity.top_k_of_part(q, c, np.arange(len(c)), np.full(len(q), -1), k, metric, 64)
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    assert set(zip(i.tolist(), j.tolist(), (rank + 1).tolist(), strict=True)) == brute(metric, q, c, 5, False)
    assert scored < most * len(q) * len(c)


@pytest.mark.parametrize("metric", ["cosine", "dot", "logistic"])
def test_few_pairs_are_scored_exactly(monkeypatch, metric):
    """Vectors that bounds skip few of: single precision passes over most pairs, and the rows are those of brute force."""
    r = np.random.default_rng(8)
    c, q = np.abs(r.normal(size=(9000, 16))) + 1, np.abs(r.normal(size=(30, 16))) / 20
    if metric == "cosine":
        c, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (c, q))
    seen, plain = [], similarity._score
    monkeypatch.setattr(similarity, "_score", lambda d, m: seen.append(d.size) or plain(d, m))
    i, j, s, scored = similarity.top_k_of_part(q, c, np.arange(len(c)), np.full(len(q), -1), np.full(len(q), 10), metric)
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    assert set(zip(i.tolist(), j.tolist(), (rank + 1).tolist(), strict=True)) == brute(metric, q, c, 10, False)
    assert scored > 0.2 * len(q) * len(c) and sum(seen) < 0.2 * scored


@pytest.mark.parametrize("scale", [1e-30, 1e-6, 1e3, 1e25])
def test_single_precision_cuts_nothing(scale):
    """Nearly equal scores, and numbers that single precision cannot hold."""
    r = np.random.default_rng(9)
    c = (1 + 1e-9 * r.integers(0, 5, size=(3000, 8))) * r.choice([1.0, 1 + 1e-7], size=(3000, 1)) * scale
    q = np.abs(r.normal(size=(20, 8))) / scale
    i, j, s, _ = similarity.top_k_of_part(q, c, np.arange(len(c)), np.arange(20), np.full(len(q), 7), "dot", 64)
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    got, d = sorted(zip(i.tolist(), rank.tolist(), j.tolist(), strict=True)), np.round(np.einsum("ik,jk->ij", q, c), similarity.DIGITS)
    best = np.array([sorted((-d[x, y], y) for y in range(len(c)) if y != x)[:7] for x in range(20)])
    assert len(got) == 140 and abs(d[i, j] + best[i, rank, 0]).max() <= 1.1e-9


def test_groups_self_and_own_k(spark):
    x = vectors(5, 150, 0.3)
    df = spark.createDataFrame([(f"v{i:03}", "abc"[i % 3], v.tolist(), i % 4 + 1) for i, v in enumerate(x)], "id string, g string, vec array<double>, n int")
    for block in (10, 1000):
        got = similarity.blocked_top_k(df, df, 0, q_id="id", q_vec="vec", c_id="id", c_vec="vec", group_col="g", exclude_self=True, k_col="n",
                                       block_size=block)
        s = score("cosine", x, x)
        want = set()
        for i in range(150):
            rows = sorted((-round(s[i, j], 9), j) for j in range(150) if j != i and j % 3 == i % 3)[:i % 4 + 1]
            want |= {(f"v{i:03}", f"v{j:03}", r + 1) for r, (_, j) in enumerate(rows)}
        assert {(r.qid, r.cid, r["rank"]) for r in got.collect()} == want


def test_nothing_to_meet(spark):
    none = spark.createDataFrame([], "id bigint, vec array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], none.schema)
    for q, c in ((none, some), (some, none), (none, none)):
        assert similarity.blocked_top_k(q, c, 3, q_id="id", q_vec="vec", c_id="id", c_vec="vec", metric="dot").count() == 0
    assert similarity.blocked_top_k(some, some, 3, q_id="id", q_vec="vec", c_id="id", c_vec="vec", exclude_self=True).count() == 0


def test_sources_are_read_once(spark, tmp_path):
    x = vectors(6, 50, 0.3)
    frame(spark, x, "id").write.parquet(str(tmp_path / "v"))
    reads = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def seen(v):
        reads.add(1)
        return v
    df = spark.read.parquet(str(tmp_path / "v")).withColumn("vec", seen("vec"))
    similarity.blocked_top_k(df, df, 3, q_id="id", q_vec="vec", c_id="id", c_vec="vec", metric="dot").collect()
    assert reads.value == len(x)


def test_more_tasks_do_not_copy_candidates_more_often(spark):
    """Every part of queries is a copy of all candidates: there are as many as fill the tasks together with the candidates' parts."""
    counts = spark.createDataFrame([(0, 900_000, 1_200_000), (1, 100, 50), (2, 0, 5)], "g int, nq bigint, nc bigint")
    got = {r.g: (r.qparts, r.cparts) for r in similarity.part_sizes(counts, 32_768, 131_072, 200).collect()}
    assert got[0] == (28, 10) and got[1] == (1, 1) and got[2][0] == 0
    few = spark.createDataFrame([(0, 51_282, 51_282)], "g int, nq bigint, nc bigint")
    assert similarity.part_sizes(few, 32_768, 131_072, 200).first()[1:] == (20, 1) and similarity.part_sizes(few, 32_768, 131_072, 8).first()[1:] == (8, 1)
