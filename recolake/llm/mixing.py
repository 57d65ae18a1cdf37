"""Mixing overlapping sources to target weights.

A document belongs to one or more sources. Documents are added up by membership pattern (the set of
their sources); a min-cost flow routes the patterns' words to the sources' quotas, where the k-th repetition of
a pattern costs more than the one before (convex), so words are repeated only where nothing fresh
is left; then seeded documents carry the flow out: of each pattern every document is taken
floor(flow / size) times, and a seeded share of its documents once more.

Sources, targets, patterns and cuts are tables: any number of sources will do. A pattern of one source that shares no document with
another needs no flow - its quota is its own - and is planned where it lies; only patterns that overlap, and those connected with them, reach the
driver, where the flow runs (at most MAX_PATTERNS of them, else ValueError). The decision
for a pattern is a repeat count and a few cuts through its documents' hash order (of id and text), so documents are
marked in place without a shuffle of their texts.

Defined results: size counts runs of characters other than ASCII white space, a null text has none; null is a
source of its own and sorts last; the same source named twice in a document counts once; a document without any
source (empty list) is never taken; rows with equal ids and texts are taken together, rows without an id by their texts; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recolake.operators.encode import row_positions

from .common import WORD, free_name, stored

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = 20
ROUNDS = 4
MAX_PATTERNS = 200_000  # that overlap
_BIN = 48  # bits of the hash below the bin: 65,536 bins a pattern
_INFINITE = 1 << 62


def quotas(sizes: dict, weights: tuple[float, ...] = WEIGHTS, total: float | None = None, repeats: int = REPEATS) -> dict:
    """Targets by source. Sources in order of code points, null last, take the weights in turn and share ``total`` words
    (default: all); no target exceeds ``repeats`` times its source's size, and what is
    above is shared again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be", "surrogatepass"))
    names += [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left = float(sum(sizes.values()) if total is None else total)
    target, open_ = dict.fromkeys(names, 0.0), list(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > repeats * sizes[s]]
        for s in above or open_:
            target[s] = float(repeats * sizes[s]) if above else unit * weight[s]
        left -= sum(target[s] for s in above)
        open_ = [s for s in open_ if above and s not in above]
    return target


def min_cost_flow(patterns: list[tuple[tuple, int]], quota: dict, repeats: int = REPEATS) -> list[dict]:
    """Words routed from each pattern (sources, size) to each of its sources. As many words as can be routed within the
    quotas, at the least cost, where the k-th pass over a pattern costs k - 1 a word."""
    flow: list[dict] = [{} for _ in patterns]
    root = {s: s for s in quota}

    def find(s):
        while root[s] != s:
            root[s] = root[root[s]]
            s = root[s]
        return s
    for sources, _ in patterns:
        for s in sources[1:]:
            root[find(s)] = find(sources[0])
    parts: dict = {}
    for i, (sources, _) in enumerate(patterns):
        if sources:
            parts.setdefault(find(sources[0]), []).append(i)
    for ids in parts.values():
        if len(ids) == 1 and len(patterns[ids[0]][0]) == 1:
            (source,), size = patterns[ids[0]]
            flow[ids[0]] = {source: min(round(quota[source]), repeats * size)}
        else:
            _route(ids, patterns, quota, repeats, flow)
    return flow


def _route(ids: list[int], patterns, quota, repeats: int, flow: list[dict]) -> None:
    """Successive cheapest paths over one connected part of the graph."""
    sources = sorted({s for i in ids for s in patterns[i][0]}, key=lambda s: (s is None, s or ""))
    place = {s: 1 + len(ids) + k for k, s in enumerate(sources)}
    end = 1 + len(ids) + len(sources)
    head, cap, cost, out = [], [], [], [[] for _ in range(end + 1)]

    def edge(a, b, c, w):
        for x, y, cc, ww in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(head))
            head.append(y)
            cap.append(cc)
            cost.append(ww)
    routes = {}
    for n, i in enumerate(ids, 1):
        for k in range(repeats):
            edge(0, n, patterns[i][1], k)
        for s in patterns[i][0]:
            routes[len(head)] = (i, s)
            edge(n, place[s], _INFINITE, 0)
    for s in sources:
        edge(place[s], end, round(quota[s]), 0)
    while True:
        far, via, queue, queued = [_INFINITE] * (end + 1), [-1] * (end + 1), deque([0]), {0}
        far[0] = 0
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in out[a]:
                if cap[e] > 0 and far[a] + cost[e] < far[head[e]]:
                    far[head[e]], via[head[e]] = far[a] + cost[e], e
                    if head[e] not in queued:
                        queued.add(head[e])
                        queue.append(head[e])
        if via[end] < 0:
            break
        path, at = [], end
        while at:
            path.append(via[at])
            at = head[via[at] ^ 1]
        most = min(cap[e] for e in path)
        for e in path:
            cap[e] -= most
            cap[e ^ 1] += most
    for e, (i, s) in routes.items():
        flow[i][s] = cap[e ^ 1]


def _memberships(docs: DataFrame, source_col: str) -> Column:
    c = F.col(source_col)
    return F.array_sort(F.array_distinct(c)) if docs.schema[source_col].dataType.typeName() == "array" else F.array(c)


def _cuts(sized: DataFrame, plan: DataFrame, nearest: bool) -> DataFrame:
    """Per pattern of the plan (pattern, rest, most, after) the cut: ``top``, the (hash, id) of the last document taken, going through
    those of at most ``most`` words behind ``after`` until ``rest`` words are full; and the words so ``used``. ``nearest``:
    the last one may go over, if that is nearer."""
    key = F.struct("u", "doc_id")
    more = sized.join(plan, "pattern").filter((F.col("size") <= F.col("most")) & (F.col("after").isNull() | (key > F.col("after"))))
    more = more.withColumn("bin", F.shiftright("u", _BIN))
    bins = more.groupBy("pattern", "rest", "bin").agg(F.sum("size").alias("words"), F.max(key).alias("top"))
    # at most 65,536 rows a pattern
    upto = Window.partitionBy("pattern").orderBy("bin")
    bins = bins.withColumn("before", F.sum("words").over(upto) - F.col("words")).filter("before <= rest")
    # whole bins first, then the documents of the one bin that holds the cut
    edge = bins.filter("before + words > rest").select("pattern", "bin", "before")
    whole = (bins.filter("before + words <= rest").groupBy("pattern")
             .agg(F.max(F.struct("top", (F.col("before") + F.col("words")).alias("used"))).alias("got")))
    inside = more.join(edge, ["pattern", "bin"])
    rank = Window.partitionBy("pattern").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("used", F.col("before") + F.sum("size").over(rank))
    inside = (inside.filter(F.col("used") - (F.col("size") / 2 if nearest else 0) <= F.col("rest")).groupBy("pattern")
              .agg(F.max(F.struct(key.alias("top"), "used")).alias("got")))
    return whole.unionByName(inside).groupBy("pattern").agg(F.max("got").alias("got")).select("pattern", "got.*")


def _hash(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))


def _targets(patterns: DataFrame, weights: tuple[float, ...], repeats: int) -> DataFrame:
    """source, source_size, target by ``quotas``, for any number of sources: the words that a unit of weight gets are found in a few sums."""
    own = patterns.select(F.explode("pattern").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = row_positions(own, [F.col("source").isNull(), F.col("source")], "_at")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_at") % len(weights) + 1).cast("int"))
    sources = stored(placed.select("source", "source_size", weight.alias("weight"), (F.lit(repeats) * F.col("source_size")).alias("cap")), "mix-sources")
    total = patterns.agg(F.sum("size")).first()[0] or 0
    unit, last = 0.0, None
    while unit != last:  # what full sources leave is shared by the others, until no other is full
        full = F.col("cap") < F.lit(unit) * F.col("weight")
        got = sources.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        last = unit
        if got[1]:
            unit = max(unit, (total - (got[0] or 0)) / got[1])
    return stored(sources.select("source", "source_size", F.when(F.col("cap") < F.lit(unit) * F.col("weight"), F.col("cap").cast("double"))
                                 .otherwise(F.lit(unit) * F.col("weight")).alias("target")), "mix-targets")


def _flows(patterns: DataFrame, targets: DataFrame, repeats: int) -> DataFrame:
    """pattern, size, words: how many words each pattern gives."""
    one = F.size("pattern") == 1
    mixed_ = patterns.filter(F.size("pattern") > 1)
    shared = stored(mixed_.select(F.explode("pattern").alias("source")).distinct(), "mix-shared").alias("m")
    alone = patterns.filter(one).withColumn("source", F.col("pattern")[0]).alias("p")
    same = F.col("p.source").eqNullSafe(F.col("m.source"))
    bound = alone.join(shared, same, "left_semi").drop("source").unionByName(mixed_)
    free = alone.join(shared, same, "left_anti").alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    plain = free.select("pattern", "size", F.least(F.rint("target").cast("long"), F.lit(repeats) * F.col("size")).alias("words"))
    none = patterns.filter(F.size("pattern") == 0).withColumn("words", F.lit(0).cast("long"))
    out = plain.unionByName(none)
    found = bound.orderBy("pattern").limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns overlap")
    if found:
        quota = {r.source: r.target for r in targets.alias("t").join(shared, F.col("t.source").eqNullSafe(F.col("m.source")), "left_semi").collect()}
        flow = min_cost_flow([(tuple(r["pattern"]), int(r["size"])) for r in found], quota, repeats)
        rows = [(list(r["pattern"]), int(r["size"]), sum(f.values())) for r, f in zip(found, flow, strict=True)]
        out = out.unionByName(patterns.sparkSession.createDataFrame(rows, "pattern array<string>, size long, words long"))
    return out


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """The mix: per pattern (an array of sources) ``base`` and ``cuts``; and per source its size and target."""
    sized = stored(docs.select(_id(id_col).alias("doc_id"), _memberships(docs, source_col).alias("pattern"), _words(text_col).alias("size"),
                               _hash(id_col, text_col, seed).alias("u")), "mix-sizes")
    patterns = stored(sized.filter("pattern is not null").groupBy("pattern").agg(F.sum("size").alias("size")), "mix-patterns")
    # documents that several sources share are available once, though each source counts them
    per_source = _targets(patterns, weights, repeats)
    cut = "struct<most: long, u: long, doc_id: long>"
    full = F.greatest("size", F.lit(1))
    state = stored(_flows(patterns, per_source, repeats).select(
        "pattern", F.floor(F.col("words") / full).alias("base"), (F.col("words") % full).alias("rest"), F.array().cast(f"array<{cut}>").alias("cuts")), "mix-plan")
    # a document too large for what is left is passed over, and smaller ones behind it fill the gap
    for turn in range(ROUNDS):
        most = F.col("rest") if turn else F.lit(_INFINITE)
        last = F.try_element_at("cuts", F.lit(-1)) if turn else F.lit(None).cast(cut)
        open_ = state.filter("rest > 0").select("pattern", "rest", most.alias("most"), F.when(last.isNotNull(), F.struct(
            last["u"].alias("u"), last["doc_id"].alias("doc_id"))).alias("after"))
        got = _cuts(sized, open_, turn == ROUNDS - 1)
        state = stored(state.join(got, "pattern", "left").select(
            "pattern", "base", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"),
            F.when(F.col("top").isNull(), F.col("cuts")).otherwise(F.concat("cuts", F.array(F.struct(
                most.alias("most"), F.col("top.u").alias("u"), F.col("top.doc_id").alias("doc_id"))))).alias("cuts")), "mix-plan")
    return state.select("pattern", "base", "cuts"), per_source


def _words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def marked(docs: DataFrame, plan: DataFrame, size: Column, hashed: Column, name: str, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The documents with the column ``name``: how often each is taken."""
    pattern, mine, key, here = (free_name(docs, x) for x in ("_pattern", "_plan", "_key", "_here"))
    side = plan.select(F.col("pattern").alias(pattern), F.struct("base", "cuts").alias(mine))
    rows = docs.withColumns({key: _memberships(docs, source_col), here: F.struct(size.alias("size"), hashed.alias("u"), _id(id_col).alias("doc_id"))})
    rows = rows.join(side, F.col(key).eqNullSafe(F.col(pattern)), "left")
    at = F.col(here)
    once_more = F.exists(F.col(mine)["cuts"], lambda c: (at["size"] <= c["most"]) & (
        (at["u"] < c["u"]) | ((at["u"] == c["u"]) & (at["doc_id"] <= c["doc_id"]))))
    copies = F.coalesce(F.col(mine)["base"], F.lit(0)) + F.coalesce(once_more, F.lit(False)).cast("long")
    return rows.withColumn(name, copies).drop(pattern, mine, key, here)


def mix_decisions(docs: DataFrame, seed: int = SEED, **settings) -> DataFrame:
    """doc_id, size, source_size, target (of the document's source), taken (words, repeats counted), for single sources."""
    plan, per_source = plan_mix(docs, seed=seed, **settings)
    rows = docs.select("doc_id", "source", _words("text").alias("size"), _hash("doc_id", "text", seed).alias("u"))
    taken = marked(rows, plan, F.col("size"), F.col("u"), "copies").alias("d")
    return taken.join(per_source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_overlapping(docs: DataFrame, source_col: str = "source", seed: int = SEED, **settings) -> DataFrame:
    """doc_id, sources, size, source_size and target (of all sources of the document, added up), taken, for documents of several sources."""
    plan, per_source = plan_mix(docs, seed=seed, source_col=source_col, **settings)
    rows = docs.select("doc_id", F.array_sort(F.array_distinct(source_col)).alias("sources"), _words("text").alias("size"),
                       _hash("doc_id", "text", seed).alias("u"))
    taken = marked(rows, plan, F.col("size"), F.col("u"), "copies", source_col="sources")
    of = (plan.select("pattern", F.explode("pattern").alias("source")).alias("p").join(per_source.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
          .groupBy("pattern").agg(F.sum("source_size").alias("source_size"), F.sum("target").alias("target")))
    return taken.join(of, F.col("sources").eqNullSafe(F.col("pattern")), "left").select(
        "doc_id", "sources", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
        (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          **settings) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with its columns."""
    plan, _ = plan_mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **settings)
    copies, one = free_name(docs, "_copies"), free_name(docs, "_copy")
    rows = marked(docs, plan, _words(text_col), _hash(id_col, text_col, seed), copies, id_col, source_col).filter(F.col(copies) > 0)
    return rows.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(copies, one)
