"""Vector scoring joins with per-key top-k (J7, W2, R3, M10 scoring).

Exact top-k similarity as blocked matrix products that leave out what cannot win:

* each side is written once (group, id, vector) and cut by a hash of the id into parts of a group, of at most ``block_size`` queries
  and ``CANDIDATE_BLOCKS`` times as many candidates; every query part meets every candidate part of its group in one task, by an
  equi join on (group, query part, candidate part) - no cross join, no pair rows, and a row is copied once per part of the other
  side. Queries are cut finer only as far as the pairs of all parts are fewer than the tasks: every further part is a copy of all candidates;
* in a task the candidates lie in chunks with a bound on what any of them can score for a query: by norm for dot products
  (|q| times the chunk's largest norm, norms descending), by pivots for cosines (the triangle inequality of angles: a
  candidate whose angle to a pivot lies in [low, high] is at least as far from a query as the query's own angle to
  the pivot lies outside of it). Every query scores its most promising chunk first; of the others only those
  whose bound reaches its k-th best score so far. Products are taken in single precision; pairs that reach the k-th best score
  within its error are scored again in double precision, and only those are ranked;
* a task emits only the k best candidates per query; the final ``row_number() <= k`` is planned with a partial
  ``WindowGroupLimit`` before its shuffle.

Ordering is ``round(score, 9)`` desc, then candidate id asc, so ties are
deterministic and equal to the SQL oracle; a bound that ties with the k-th best score is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import scratch_folder
from .popular import top_k_per_key

BLOCK_ROWS = 32_768  # queries of a part
CANDIDATE_BLOCKS = 4  # times as many candidates: each of their parts is a copy of all queries and returns k rows for each
TASK_PAIRS = 1 << 27  # that a task meets at least (seconds of work), where its parts can hold them
CHUNK_ROWS = 512
TILE_ROWS = 1024  # queries that meet a chunk at once: few enough for the processor's cache
PIVOTS = 8
DIGITS = 9
SLACK = 1e-8  # what rounding to DIGITS and the last bits of a bound can amount to


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors as a matrix."""
    flat = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _chunks(c: np.ndarray, q: np.ndarray, metric: str, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of the candidates by chunk, and per query and chunk a bound on the dot product."""
    norm = np.sqrt((c * c).sum(axis=1))
    if metric != "cosine":
        order = np.argsort(-norm, kind="stable")
        rows = [order[a:a + size] for a in range(0, len(order), size)]
        return rows, np.sqrt((q * q).sum(axis=1))[:, None] * np.array([norm[r[0]] for r in rows])
    # vectors without a direction score 0 with everything and are no part of the angles
    zero, rest = np.flatnonzero(norm < 0.5), np.flatnonzero(norm >= 0.5)
    rows = [zero[a:a + size] for a in range(0, len(zero), size)]
    bound = [np.zeros((len(q), len(rows)))]
    if len(rest):
        # pivots far from each other: each is the candidate that lies furthest from those before
        chosen, nearest = [rest[0]], np.full(len(rest), -np.inf)
        while len(chosen) < min(PIVOTS, len(rest)):
            nearest = np.maximum(nearest, c[rest] @ c[chosen[-1]])
            chosen.append(rest[nearest.argmin()])
        angle = np.arccos(np.clip(c[rest] @ c[chosen].T, -1, 1))
        asked = np.arccos(np.clip(q @ c[chosen].T, -1, 1))
        home = angle.argmin(axis=1)
        order = np.lexsort((angle[np.arange(len(rest)), home], home))
        own = [order[a:a + size] for a in range(0, len(order), size)]
        gap = np.zeros((len(q), len(own)))
        for k, part in enumerate(own):
            low, high = angle[part].min(axis=0), angle[part].max(axis=0)
            gap[:, k] = np.maximum(low - asked, asked - high).max(axis=1)
        best = np.cos(np.maximum(gap, 0))
        best[(q * q).sum(axis=1) < 0.5] = 0.0
        bound.append(best)
        rows += [rest[part] for part in own]
    return rows, np.concatenate(bound, axis=1)


def _score(dots: np.ndarray, metric: str) -> np.ndarray:
    if metric == "logistic":
        return 1.0 / (1.0 + np.exp(np.minimum(-dots, 700)))
    return dots + 1.0 if metric == "cosine" else dots


def _least_dot(least: np.ndarray, metric: str) -> np.ndarray:
    """The dot product below which a rounded score cannot reach ``least``."""
    low = least - SLACK
    if metric == "logistic":
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(low > 0, np.log(low) - np.log1p(-low), -np.inf)
    return low - 1.0 if metric == "cosine" else low


def top_k_of_part(q: np.ndarray, c: np.ndarray, place: np.ndarray, own: np.ndarray, k: np.ndarray, metric: str,
                  size: int = CHUNK_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query rows, candidate rows and scores of the best k[i] candidates of every query, and how many pairs were scored. ``place`` ranks
    candidates that tie; ``own`` is the candidate row that a query is not to meet (-1: none).

    Dot products are taken in single precision first, whose error is at most ``margin``; pairs that can still be among the best are scored in
    double precision, and only these are ranked."""
    rows, bound = _chunks(c, q, metric, size)
    bound = _score(bound, metric) + SLACK
    most = int(k.max()) if len(k) else 0
    least = np.full(len(q), -np.inf)  # the k-th best rounded score so far, or less
    below = np.full(len(q), -np.inf)  # the dot product that it takes
    held: list[tuple[np.ndarray, ...]] = []
    waiting = scored = 0
    width, large = c.shape[1], max(np.abs(q).max(initial=0), np.abs(c).max(initial=0))
    # beyond these numbers single precision could overflow; what it loses of tiny ones is far less than SLACK
    kind = np.float32 if large < 1e15 else np.float64
    unit = np.finfo(kind).eps * (width + 8)
    fast, chunks = q.astype(kind), [c[chunk].astype(kind).T for chunk in rows]
    length, longest = np.sqrt((q * q).sum(axis=1)), [np.sqrt((c[chunk] ** 2).sum(axis=1).max()) for chunk in rows]
    alone = not (own >= 0).any()
    tile = np.empty((TILE_ROWS, size), kind)

    def cut() -> None:
        nonlocal held, waiting
        i, j, s, r = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place[j], -r, i))
        i, j, s, r = i[order], j[order], s[order], r[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k[i]
        full = rank == k[i] - 1
        least[i[full]] = np.maximum(least[i[full]], r[full])
        below[i[full]] = _least_dot(least[i[full]], metric)
        held, waiting = [(i[keep], j[keep], s[keep], r[keep])], 0

    def meet(at: np.ndarray, n: int, seed: bool = False) -> None:
        nonlocal waiting, scored
        chunk = rows[n]
        for a in range(0, len(at), TILE_ROWS):
            part = at[a:a + TILE_ROWS]
            s = np.matmul(fast[part], chunks[n], out=tile[:len(part), :len(chunk)])
            scored += s.size
            margin = unit * longest[n] * length[part] + SLACK
            if not alone:
                s[own[part][:, None] == chunk[None, :]] = -np.inf
            if seed and s.shape[1] > most:
                # so many reach this at least
                reached = np.partition(s, -most, axis=1)[:, -most] - margin
                least[part] = np.maximum(least[part], np.round(_score(reached, metric), DIGITS))
                below[part] = _least_dot(least[part], metric)
            floor = below[part] - margin
            # rows without a pair that reaches its floor are done; "not below" keeps what is not a number for the exact score
            some = np.flatnonzero(~(s.max(axis=1) < floor))
            at_flat = np.flatnonzero(~(s[some] < floor[some][:, None]))
            i, j = part[some[at_flat // s.shape[1]]], chunk[at_flat % s.shape[1]]
            if not alone:
                other = own[i] != j
                i, j = i[other], j[other]
            exact = _score(np.einsum("ij,ij->i", q[i], c[j]), metric)
            r = np.round(exact, DIGITS)
            keep = (r >= least[i]) & np.isfinite(exact)
            held.append((i[keep], j[keep], exact[keep], r[keep]))
            waiting += int(keep.sum())
            if waiting > 1 << 20:
                cut()

    if len(rows) and len(q):
        first = bound.argmax(axis=1)
        for n in range(len(rows)):
            if len(at := np.flatnonzero(first == n)):
                meet(at, n, True)
        if held:
            cut()
        # chunks that promise most on the whole come first; the k-th best rises as fast as the number of chunks doubles
        for done, n in enumerate(np.argsort(-bound.max(axis=0), kind="stable"), 1):
            if len(at := np.flatnonzero((bound[:, n] >= least - SLACK) & (first != n))):
                meet(at, n)
            if held and waiting and done & (done - 1) == 0:
                cut()
        if held:
            cut()
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), scored
    i, j, s, _ = held[0]
    return i, j, s, scored


def _kernel(metric: str, exclude_self: bool, size: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, others = left["id"].combine_chunks(), right["id"].combine_chunks()
        if not len(ids) or not len(others):
            return pa.table({"qid": ids.slice(0, 0), "cid": others.slice(0, 0), "score": pa.array([], pa.float64()), "pairs": pa.array([], pa.int64())})
        place = np.empty(len(others), np.int64)
        place[pa.compute.sort_indices(others).to_numpy()] = np.arange(len(others))
        own = np.full(len(ids), -1)
        if exclude_self:
            own = pa.compute.index_in(ids, value_set=others).fill_null(-1).to_numpy(zero_copy_only=False)
        i, j, s, scored = top_k_of_part(_matrix(left["vec"]), _matrix(right["vec"]), place, own, left["_k"].to_numpy(), metric, size)
        # a row without a query reports how many of the part's pairs were scored, and how many there are
        return pa.table({"qid": pa.concat_arrays([ids.take(pa.array(i)), pa.nulls(1, ids.type)]), "cid": pa.concat_arrays(
            [others.take(pa.array(j)), pa.nulls(1, others.type)]), "score": pa.array(np.append(s, float(len(ids) * len(others)))),
            "pairs": pa.array([None] * len(s) + [scored], pa.int64())})
    return run


def part_sizes(counts: DataFrame, most_queries: int, most_candidates: int, tasks: int) -> DataFrame:
    """(g, qparts, cparts) for (g, nq, nc): candidates in as few parts as may be; queries in parts of at most ``most_queries``, smaller ones
    only as far as every task gets its share of all pairs, ``TASK_PAIRS`` at least."""
    pairs = counts.agg(F.sum(F.col("nq").cast("double") * F.col("nc"))).first()[0] or 0.0
    share = F.ceil(F.lit(max(TASK_PAIRS, pairs / tasks)) / F.least("nc", F.lit(most_candidates)))
    rows = F.least(F.lit(most_queries), share)
    return counts.select("g", F.ceil(F.col("nq") / rows).alias("qparts"), F.ceil(F.col("nc") / most_candidates).alias("cparts"))


def blocked_top_k(queries: DataFrame, candidates: DataFrame, k: int, *,
                  q_id: str, q_vec: str, c_id: str, c_vec: str,
                  group_col: str | None = None, metric: str = "cosine",
                  exclude_self: bool = False, block_size: int = BLOCK_ROWS,
                  k_col: str | None = None, report: dict | None = None) -> DataFrame:
    """(qid, cid, score, rank): exact top-k candidates per query.

    ``k_col`` (a column of ``queries``) gives each query its own k; ``k`` is
    then ignored and the final ranking keeps rank <= that query's k.

    ``metric``: 'cosine' (cosine + 1) or 'logistic' (sigmoid of dot) or 'dot'.
    Rows without a usable vector (``has_vector``) or id must be filtered by the caller; all vectors have one length.
    ``report`` receives the pairs there were and the pairs scored.
    """
    spark = queries.sparkSession
    scratch = scratch_folder(spark, "top-k")
    group = F.col(group_col) if group_col else F.lit(0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def written(df: DataFrame, vec: str, name: str, *more) -> DataFrame:
        # single precision stays as it is on the way, the kernel computes in double
        v = _unit(vec) if metric == "cosine" else F.col(vec) if dict(df.dtypes)[vec] == "array<float>" else F.col(vec).cast("array<double>")
        df.select(group.alias("g"), *more, v.alias("vec")).write.parquet(f"{scratch}/{name}")
        return spark.read.parquet(f"{scratch}/{name}")
    own_k = (F.col(k_col) if k_col else F.lit(k)).cast("bigint").alias("_k")
    q = written(queries, q_vec, "queries", F.col(q_id).alias("id"), own_k)
    if candidates is queries and (q_id, q_vec) == (c_id, c_vec):
        c = spark.read.parquet(f"{scratch}/queries").drop("_k")
    else:
        c = written(candidates, c_vec, "candidates", F.col(c_id).alias("id"))
    most = CANDIDATE_BLOCKS * block_size
    counts = q.groupBy("g").agg(F.count(F.lit(1)).alias("nq")).join(c.groupBy("g").agg(F.count(F.lit(1)).alias("nc")), "g")
    sizes = part_sizes(counts, block_size, most, parts)
    part = lambda of: F.pmod(F.xxhash64("id"), F.col(of))
    spread = lambda of: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(of) - 1))
    left = q.join(sizes, "g").select("g", part("qparts").alias("qpart"), spread("cparts").alias("cpart"), "id", "_k", "vec")
    right = c.join(sizes, "g").select("g", spread("qparts").alias("qpart"), part("cparts").alias("cpart"), "id", "vec")
    keys = ["g", "qpart", "cpart"]
    # ids keep their type (integer or string labels)
    schema = f"qid {dict(q.dtypes)['id']}, cid {dict(c.dtypes)['id']}, score double, pairs bigint"
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _kernel(metric, exclude_self, min(block_size, CHUNK_ROWS)), schema)
    if report is not None:
        scored.write.parquet(f"{scratch}/scored")
        scored = spark.read.parquet(f"{scratch}/scored")
        total = scored.filter("qid is null").agg(F.sum("score"), F.sum("pairs")).first()
        report.update(pairs=int(total[0] or 0), scored=int(total[1] or 0))
    scored = scored.filter("qid is not null").drop("pairs")
    order = [F.round("score", DIGITS).desc(), F.col("cid")]
    if k_col:
        kq = q.select(F.col("id").alias("qid"), "_k")
        return top_k_per_key(scored.join(kq, "qid"), ["qid"], order, 1 << 62).filter(F.col("rank") <= F.col("_k")).drop("_k")
    return top_k_per_key(scored, ["qid"], order, k)


def _unit(col: str):
    n = V.norm(col)
    return F.when(n > 0, F.transform(F.col(col), lambda x: x.cast("double") / n)).otherwise(
        F.transform(F.col(col), lambda x: F.lit(0.0)))


def similar_items(items: DataFrame, vectors: DataFrame, num: int = 10, metric: str = "cosine",
                  queries: DataFrame | None = None, block_size: int = BLOCK_ROWS, report: dict | None = None) -> DataFrame:
    """For each query item with a vector: the num most similar items of the
    same category (all items when its category is null), self excluded.

    Candidates without a vector score 0 (the reference's script returns 0),
    so they only appear when a category has fewer than num scored candidates;
    ``queries`` (item_id) restricts the query side, default = every item.
    Output: item_id, rank, similar_id, score.
    """
    spark = items.sparkSession
    path = f"{scratch_folder(spark, 'similar')}/items"
    # items and vectors are joined and written once; every branch below reads what it needs of that
    (items.select("item_id", "main_category").join(vectors.select("item_id", "model_factor"), "item_id", "left")
     .withColumn("has", V.has_vector("model_factor")).write.parquet(path))
    vec_items = spark.read.parquet(path)
    with_v = vec_items.filter("has").drop("has")
    q = with_v if queries is None else with_v.join(queries.select("item_id").distinct(), "item_id", "left_semi")
    known = q.filter(F.col("main_category").isNotNull())
    columns = dict(q_id="item_id", q_vec="model_factor", c_id="item_id", c_vec="model_factor", metric=metric, exclude_self=True,
                   block_size=block_size)
    held = known if queries is None else with_v.filter(F.col("main_category").isNotNull())
    scored = blocked_top_k(known, held, num, group_col="main_category", report=report, **columns).select("qid", "cid", "score")
    unknown = q.filter(F.col("main_category").isNull())
    if not unknown.isEmpty():
        scored = scored.unionByName(blocked_top_k(unknown, with_v, num, **columns).select("qid", "cid", "score"))
    # zero-score padding: per category the num lowest-id items without a vector
    no_v = vec_items.filter(~F.col("has") & F.col("main_category").isNotNull())
    pad = top_k_per_key(no_v, ["main_category"], [F.col("item_id")], num, "_r")
    pads = (known.select(F.col("item_id").alias("qid"), "main_category")
            .join(pad.select("main_category", F.col("item_id").alias("cid")), "main_category")
            .filter(F.col("qid") != F.col("cid"))
            .select("qid", "cid", F.lit(0.0).alias("score")))
    ranked = top_k_per_key(scored.unionByName(pads), ["qid"], [F.round("score", DIGITS).desc(), F.col("cid")], num)
    return ranked.select(F.col("qid").alias("item_id"), "rank", F.col("cid").alias("similar_id"), "score")
