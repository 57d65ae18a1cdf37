"""Exact Jaccard join of word 5-gram sets, and the components of its links.

Candidates. All sets order their shingles in one way: by how common a shingle is, then by its hash. Two sets that link
share a shingle in their prefixes, the first n - ceil(0.75 n) + 1 in that order; of the smaller set the first
n - ceil(6 n / 7) + 1 are enough (its index prefix). The prefixes' shingles are dealt out by hash; sets that share one
there, and lie close enough in size, come under the same leader, the smallest that has it in its index prefix.
All sets of a leader form one unit, so every pair that can link meets in some unit. (How common a
shingle is comes from counts over all documents; the 2**20 commonest are told apart, which steers speed and never results.
The counts go by bucket and 32 bits of the hash: sorted, as Simple-8b differences, about three bytes a shingle.)

Set relations within a unit (``unit_links``). Index lists are kept in blocks of equal size ordered by the position of the
shingle in the set, so that the rest of a block is skipped once the position rules a link out. A set's
overlaps with all others are counted once; those of a set highly similar to it are derived from them by adding the
lists of the shingles it has more and subtracting those it has less. Sets that can only reach what they are
connected with already, by the triangle inequality of the Jaccard distance, need no answer of their own.

Numbers of links (``unit_counts``, for ``jaccard_join``): every pair of a unit is evaluated, weighted by how many rows have the
sets; a pair under several leaders counts under the first of them, a pair of one part in the part's own cell.

Equal sets collapse before any of this: they travel as one (a 64-bit digest with the set's size). Units above UNIT_SHINGLES
shingles are cut into cells that pair up all their parts, so no pair is lost and no task holds more.

Defined results: null and empty texts, and texts of white space, have the empty set, no links and their own id as component;
rows that repeat a doc_id are one node with all their links; rows with a null id have a null component unless linked
(then the smallest id reachable); hashes of 64 bits stand for shingles; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simple8b
from .common import free_name, shingle_sets, stored
from .components import connected_components

WORDS = 5
PERCENT = 75  # two sets link when 100 * intersection >= PERCENT * union
UNIT_SHINGLES = 2_000_000
COMMON = 1 << 20  # shingles whose frequency class is known to all tasks
COUNT_BATCH = 4_000_000  # shingles counted together in a task
FILTER_BITS = 1 << 23


def linked(overlap, a, b):
    return 100 * overlap >= PERCENT * (a + b - overlap)


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1 if n else 0


def index_prefix_length(n: int) -> int:
    """Of the smaller set of a linked pair: it holds at least 2 * PERCENT / (100 + PERCENT) of its own shingles in common."""
    return n + 2 * PERCENT * n // -(100 + PERCENT) + 1 if n else 0


def digest(s: np.ndarray) -> int:
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def count_keys(s: np.ndarray, buckets: int) -> np.ndarray:
    """What a shingle is counted under: its bucket (a power of two of them) and 32 further bits."""
    return ((s & np.uint64(buckets - 1)) << np.uint64(32)) | ((s >> np.uint64(20)) & np.uint64(0xFFFFFFFF))


class Order:
    """Frequency classes of the commonest shingles, by count key; every other shingle has class 0."""

    def __init__(self, keys: np.ndarray, classes: np.ndarray, buckets: int):
        self.keys, self.classes, self.buckets = keys, classes, buckets
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def prefix(self, s: np.ndarray) -> np.ndarray:
        """The first shingles of a set (given sorted by hash)."""
        length = prefix_length(len(s))
        if not len(self.keys):
            return s[:length]
        keys = count_keys(s, self.buckets)
        maybe = np.flatnonzero(self.seen[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = np.searchsorted(self.keys, keys[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys[maybe]
        maybe, at = maybe[hit], at[hit]
        if not len(maybe):
            return s[:length]
        rare = np.ones(len(s), bool)
        rare[maybe] = False
        if rare.sum() >= length:
            return s[rare][:length]
        return np.concatenate((s[rare], s[maybe][np.argsort(self.classes[at], kind="stable")]))[:length]


def unit_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) of sorted sets that connect all of their components (a spanning forest, not all pairs)."""
    m = len(sets)
    links: list[tuple[int, int]] = []
    if m == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if both and linked(both, len(sets[0]), len(sets[1])) else []
    order = sorted(range(m), key=lambda i: len(sets[i]))
    while True:
        m = len(order)
        size = np.array([len(sets[i]) for i in order], np.int64)
        if m < 2:
            return links
        owner = np.repeat(np.arange(m), size)
        _, element, frequency = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
        # a set that shares too little even with all others together links with none
        shared = np.bincount(owner, frequency[element] > 1, m)
        able = shared * 100 >= size * PERCENT
        if able.all():
            break
        order = [i for i, x in zip(order, able, strict=True) if x]
    # each set's elements by rarity; an element in one set alone links nothing and only takes up a position
    by = np.lexsort((element, frequency[element], owner))
    element = element[by]
    begin = np.concatenate(([0], np.cumsum(size)))
    position = np.arange(len(element)) - begin[owner]
    # index lists by element; in a list blocks by size, in a block by position
    listed = np.lexsort((position, size[owner], element))
    list_of = np.concatenate(([0], np.cumsum(frequency)))
    l_owner, l_size, l_position = owner[listed], size[owner[listed]], position[listed]
    group = np.arange(m)

    def find(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    def join(i, others) -> None:
        for j in others.tolist():
            a, b = find(i), find(j)
            if a != b:
                group[max(a, b)] = min(a, b)
                links.append((order[i], order[j]))

    def lists(elements) -> np.ndarray:
        """All owners in the lists of the elements, one after the other."""
        a, n = list_of[elements], frequency[elements]
        if not len(elements):
            return np.zeros(0, np.int64)
        return l_owner[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def candidates(i) -> np.ndarray:
        """Sets after i (not smaller) that share a prefix element where size and position allow a link."""
        n, out = size[i], []
        first = element[begin[i]:begin[i] + index_prefix_length(n)]
        for p in np.flatnonzero(frequency[first] > 1).tolist():
            a, b = list_of[first[p]], list_of[first[p] + 1]
            a, b = np.searchsorted(l_size[a:b], (n, n * 100 // PERCENT), "left")[0] + a, np.searchsorted(l_size[a:b], n * 100 // PERCENT, "right") + a
            while a < b:
                block = int(np.searchsorted(l_size[a:b], l_size[a], "right")) + a
                # overlap needed with sets of this size; the one here and at most all behind it can be common
                least = -(-PERCENT * (n + l_size[a]) // (100 + PERCENT))
                if n - p >= least:
                    stop = int(np.searchsorted(l_position[a:block], l_size[a] - least, "right")) + a
                    out.append(l_owner[a:stop])
                a = block
        found = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return found[found > i]

    def elements(i) -> np.ndarray:
        return element[begin[i]:begin[i + 1]]
    answered = np.zeros(m, bool)
    marks = np.zeros(len(frequency), bool)
    roots, known = np.arange(m), 0
    for i in range(m):
        if answered[i]:
            continue
        if len(links) > known:
            roots, known = np.fromiter((find(j) for j in range(m)), np.int64, m), len(links)
        within = np.searchsorted(size, size[i] * 100 // PERCENT, "right")
        if (roots[i:within] == roots[i]).all():
            continue  # all that it could reach from here on
        near = candidates(i)
        near = near[[find(j) != find(i) for j in near]]
        if not len(near):
            continue
        if len(near) <= 8:
            marks[elements(i)] = True
            common = np.array([int(marks[elements(j)].sum()) for j in near])
            marks[elements(i)] = False
            join(i, near[linked(common, size[i], size[near])])
            continue
        # one full answer, from which those of highly similar sets are derived
        common = np.bincount(lists(elements(i)), minlength=m)
        similar = np.flatnonzero(linked(common, size[i], size) & (common > 0))
        join(i, similar)
        answered[i] = True
        distance = 1 - common / (size[i] + size - common)
        roots, known = np.fromiter((find(j) for j in range(m)), np.int64, m), len(links)
        for j in similar:
            if answered[j]:
                continue
            answered[j] = True
            reach = (size >= size[j] * PERCENT // 100) & (size * PERCENT <= size[j] * 100) & (np.abs(distance - distance[j]) <= 1 - PERCENT / 100 + 1e-9)
            if not (reach & (roots != find(j))).any():
                continue
            more, less = np.setdiff1d(elements(j), elements(i), True), np.setdiff1d(elements(i), elements(j), True)
            derived = common + np.bincount(lists(more), minlength=m) - np.bincount(lists(less), minlength=m)
            join(j, np.flatnonzero(linked(derived, size[j], size) & (derived > 0)))
            if len(links) > known:
                roots, known = np.fromiter((find(x) for x in range(m)), np.int64, m), len(links)
    return links


def unit_counts(sets: list[np.ndarray], weight: np.ndarray, leads: list[np.ndarray], part: np.ndarray | None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For every sorted set the weight of all sets that it links with, and a spanning forest of these links. Every pair is evaluated,
    but for those that belong to another unit (they share one of the given leaders) or cell (they are of one part)."""
    counts, links = np.zeros(len(sets), np.int64), []
    order = np.arange(len(sets))
    while True:
        m = len(order)
        if m < 2:
            return counts, links
        size = np.array([len(sets[i]) for i in order], np.int64)
        owner = np.repeat(np.arange(m), size)
        _, element, frequency = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
        # a set that shares too little even with all others together links with none
        able = np.bincount(owner, frequency[element] > 1, m) * 100 >= size * PERCENT
        if able.all():
            break
        order = order[able]
    weight = weight[order]
    part = None if part is None else part[order]
    listed = owner[np.argsort(element, kind="stable")]
    list_of = np.concatenate(([0], np.cumsum(frequency)))
    begin = np.concatenate(([0], np.cumsum(size)))
    # the shared leaders in the same way; sets with the same leaders have the same answer
    groups: dict[bytes, int] = {}
    group = np.array([groups.setdefault(np.sort(leads[i]).tobytes(), len(groups)) for i in order])
    signature = [np.frombuffer(x, np.int64) for x in groups]
    lead_of = np.repeat(np.arange(len(signature)), [len(x) for x in signature])
    _, lead, held = np.unique(np.concatenate(signature), return_inverse=True, return_counts=True)
    led = lead_of[np.argsort(lead, kind="stable")]
    led_at = np.concatenate(([0], np.cumsum(held)))
    lead_begin = np.concatenate(([0], np.cumsum([len(x) for x in signature])))

    def lists(which, owners, at, n) -> np.ndarray:
        a, n = at[which], n[which]
        return owners[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())] if len(which) else np.zeros(0, np.int64)

    def elements(i) -> np.ndarray:
        return element[begin[i]:begin[i + 1]]
    elsewhere: dict[int, np.ndarray] = {}

    def open_to(i) -> np.ndarray:
        """The sets after i whose pair with i belongs here."""
        g = int(group[i])
        if g not in elsewhere:
            if len(elsewhere) >= 64:
                elsewhere.clear()
            shared = np.zeros(len(signature), bool)
            shared[lists(lead[lead_begin[g]:lead_begin[g + 1]], led, led_at, held)] = True
            elsewhere[g] = shared[group]
        mine = ~elsewhere[g]
        mine[:i + 1] = False
        return mine if part is None else mine & (part != part[i])
    root = np.arange(m)

    def answer(i, common, mine) -> None:
        near = np.flatnonzero((common > 0) & mine)
        near = near[linked(common[near], size[i], size[near])]
        counts[order[i]] += weight[near].sum()
        counts[order[near]] += weight[i]
        apart = near[root[near] != root[i]]
        for r, at in zip(*np.unique(root[apart], return_index=True), strict=True):
            links.append((int(order[i]), int(order[apart[at]])))
            root[root == r] = root[i]
    done = np.zeros(m, bool)
    for i in range(m):
        if done[i]:
            continue
        done[i] = True
        mine = open_to(i)
        if not mine.any():
            continue
        common = np.bincount(lists(elements(i), listed, list_of, frequency), minlength=m)
        answer(i, common, mine)
        # the rows of highly similar sets are derived from this one
        for j in np.flatnonzero(~done & (common > 0) & linked(common, size[i], size)).tolist():
            done[j] = True
            mine = open_to(j)
            if mine.any():
                more, less = np.setdiff1d(elements(j), elements(i), True), np.setdiff1d(elements(i), elements(j), True)
                answer(j, common + np.bincount(lists(more, listed, list_of, frequency), minlength=m)
                       - np.bincount(lists(less, listed, list_of, frequency), minlength=m), mine)
    return counts, links


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _sets(texts: DataFrame) -> DataFrame:
    """doc_id, digest, n of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = shingle_sets(b["text"].tolist(), WORDS)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "digest": [digest(s) for s in sets], "n": [len(s) for s in sets]})
    return texts.mapInPandas(run, "doc_id long, digest long, n long")


def _counts(texts: DataFrame, buckets: int) -> DataFrame:
    """key, n: how many sets hold a shingle, where that is three or more (each task counts equal sets once)."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total, seen = [], 0, set()

        def packed():
            keys, times = np.unique(count_keys(np.concatenate(held), buckets), return_counts=True)
            cut = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
            rows = []
            for bucket, (a, z) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                if z > a:
                    part = keys[a:z] & np.uint64(0xFFFFFFFF)
                    steps = np.concatenate((part[:1], np.diff(part)))
                    rows.append((bucket, z - a, simple8b.encode(steps).astype("<u8").tobytes(),
                                 simple8b.encode(times[a:z]).astype("<u8").tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "size", "steps", "times"])
        for b in batches:
            for s in shingle_sets(b["text"].tolist(), WORDS):
                key = digest(s)
                if len(s) and key not in seen:
                    held.append(s)
                    total += len(s)
                    seen.add(key)
                if total >= COUNT_BATCH:
                    yield packed()
                    held, total, seen = [], 0, set()
        if held:
            yield packed()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, bucket = [], None

        def added():
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([t for _, t in held])).astype(np.int64)
            return pd.DataFrame({"key": keys[n >= 3].astype(np.int64) + (bucket << 32), "n": n[n >= 3]})
        for b in batches:
            for r in b.itertuples(index=False):
                if r.bucket != bucket and held:
                    yield added()
                    held = []
                bucket = int(r.bucket)
                held.append((np.cumsum(simple8b.decode(np.frombuffer(r.steps, "<u8"), r.size)),
                             simple8b.decode(np.frombuffer(r.times, "<u8"), r.size).astype(np.int64)))
        if held:
            yield added()
    parts = texts.mapInPandas(pack, "bucket int, size int, steps binary, times binary")
    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(add, "key long, n long")


def _order(texts: DataFrame) -> Order:
    """The frequency classes of at most COMMON shingles, the commonest (at most 16 MB reach the driver)."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(1 << 20, 1 << max(8, (4 * partitions - 1).bit_length()))
    counts = stored(_counts(texts, buckets).withColumn("grade", F.floor(8 * F.log2("n")).cast("int")), "shingle-counts")
    least, room = 0, COMMON
    for r in counts.groupBy("grade").count().orderBy(F.desc("grade")).collect():
        room -= r["count"]
        if room < 0:
            least = r.grade + 1
            break
    got = counts.filter(F.col("grade") >= least).select("key", "grade").toArrow()
    keys, grades = got["key"].to_numpy().astype(np.uint64), got["grade"].to_numpy()
    by = np.argsort(keys)
    return Order(keys[by], (grades[by] // 8).astype(np.int8), buckets)


def _under_leaders(texts: DataFrame, order: Order) -> DataFrame:
    """lead, lead_n, digest, n: the sets that share a prefix shingle with a smaller set, under the smallest of them."""
    sent = texts.sparkSession.sparkContext.broadcast(order)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        o, seen = sent.value, set()
        for b in batches:
            parts, keys = [], []
            for s in shingle_sets(b["text"].tolist(), WORDS):
                key = (digest(s), len(s))
                if len(s) and key not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(key)
                    parts.append(o.prefix(s))
                    keys.append(key)
            if parts:
                n = [len(p) for p in parts]
                beyond = np.concatenate([np.arange(len(p)) >= index_prefix_length(k) for p, (_, k) in zip(parts, keys, strict=True)])
                yield pd.DataFrame({"shingle": np.concatenate(parts).view(np.int64), "digest": np.repeat([k for k, _ in keys], n),
                                    "n": np.repeat([k for _, k in keys], n).astype(np.int32), "beyond": beyond})

    def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # of the run that goes on: the row before, the leader, whether it has been told, and the last member
        before = leader = member = None
        told = False
        for b in batches:
            if not len(b):
                continue
            s, d, n = b["shingle"].to_numpy(), b["digest"].to_numpy(), b["n"].to_numpy().astype(np.int64)
            index = ~b["beyond"].to_numpy(bool)
            ps, pn = before or (s[0], n[0])
            ps, pn = np.concatenate(([ps], s[:-1])), np.concatenate(([pn], n[:-1]))
            new = (s != ps) | (n * PERCENT > pn * 100)
            new[0] |= before is None
            before = s[-1], n[-1]
            if new[0]:
                leader = member = None
                told = False
            run = np.cumsum(new)
            run -= run[0]
            # rows from a run's first index row on
            begin = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            seen = np.cumsum(index)
            seen = seen - (seen[begin] - index[begin])[run] > 0
            if leader is not None:
                seen |= run == 0
            last_run = run[-1]
            run, d, n = run[seen], d[seen], n[seen]
            head = np.concatenate(([True], run[1:] != run[:-1]))[:len(run)]
            if leader is not None and len(run) and run[0] == 0:
                head[0] = False
            at = np.cumsum(head) - 1  # of the head; -1: the leader from before
            hd, hn = d[head], n[head]
            ld = np.where(at < 0, leader[0] if leader else 0, hd[at] if len(hd) else 0)
            ln = np.where(at < 0, leader[1] if leader else 0, hn[at] if len(hn) else 0)
            pd_, pn_ = (np.concatenate(([m], v[:-1])) for m, v in zip(member or (0, 0), (d, n), strict=True)) if len(d) else (d, n)
            joins = ~head & ~((d == pd_) & (n == pn_))  # not the same set from another task
            out = pd.DataFrame({"lead": ld[joins], "lead_n": ln[joins], "digest": d[joins], "n": n[joins]})
            heads = out[["lead", "lead_n"]].drop_duplicates()
            if told and leader is not None:
                heads = heads[(heads["lead"] != leader[0]) | (heads["lead_n"] != leader[1])]
            yield pd.concat([out, heads.assign(digest=heads["lead"], n=heads["lead_n"])]).drop_duplicates()
            if len(run) and run[-1] == last_run:
                told = bool(joins[run == last_run].any()) or (told and last_run == 0)
                leader, member = (int(ld[-1]), int(ln[-1])), (int(d[-1]), int(n[-1]))
            elif last_run > 0:
                leader = member = None
                told = False
    postings = texts.mapInPandas(post, "shingle long, digest long, n int, beyond boolean")
    dealt = postings.repartition("shingle").sortWithinPartitions("shingle", "n", "beyond", "digest")
    return dealt.mapInPandas(lead, "lead long, lead_n long, digest long, n long").distinct()


def _with_texts(texts: DataFrame, members: DataFrame) -> DataFrame:
    """digest, n, text: one text for every set among the members. A bitmap of fixed size keeps most others from being moved."""
    place = F.pmod("digest", F.lit(FILTER_BITS))
    words = members.select(place.alias("b")).groupBy((F.col("b") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for b in batches:
            rows = []
            for t, s in zip(b["text"], shingle_sets(b["text"].tolist(), WORDS), strict=True):
                key = digest(s)
                at = key % FILTER_BITS
                if (key, len(s)) not in seen and int(sent.value[at // 64]) >> (at % 64) & 1:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add((key, len(s)))
                    rows.append((key, len(s), t))
            yield pd.DataFrame(rows, columns=["digest", "n", "text"])
    return texts.mapInPandas(run, "digest long, n long, text string").groupBy("digest", "n").agg(F.min("text").alias("text"))


def _linked_sets(texts: DataFrame, members: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """da, na, db, nb, w: links between sets that connect all of their components (w is null); with weights (digest, n, w) also
    rows of a set alone (db and nb are null), w the weight of the sets that it links with, to be added up."""
    units = members.groupBy("lead", "lead_n").agg(F.sum("n").alias("total")).withColumn(
        "parts", F.ceil(F.col("total") / UNIT_SHINGLES).cast("int"))
    large = units.filter("parts > 1").select("lead", "lead_n", "parts")
    cells = members.join(large, ["lead", "lead_n"], "left")
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("digest", "n"), parts).cast("int")
    cells = cells.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = cells.select("lead", "lead_n", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "digest", "n", "part")
    rows = cells.join(_with_texts(texts, members), ["digest", "n"])
    if weights is not None:
        # a pair counts under the first leader that both have
        leads = members.groupBy("digest", "n").agg(F.collect_set("lead").alias("leads"))
        rows = rows.join(leads, ["digest", "n"]).join(weights, ["digest", "n"])
        rows = rows.withColumn("leads", F.filter("leads", lambda x: x < F.col("lead")))
    unit = ["lead", "lead_n", "x", "y"]
    rows = rows.repartition(*unit).sortWithinPartitions(*unit, "n", "digest")

    counting = weights is not None

    def solve(held: list[pd.DataFrame]) -> list[tuple[int, int, int | None, int | None, int | None]]:
        whole = pd.concat(held) if len(held) > 1 else held[0]
        d, n = whole["digest"].tolist(), whole["n"].tolist()
        sets = shingle_sets(whole["text"].tolist(), WORDS)
        if not counting:
            return [(d[i], n[i], d[j], n[j], None) for i, j in unit_links(sets)]
        across = whole["part"].to_numpy() if whole["x"].iloc[0] != whole["y"].iloc[0] else None
        counts, links = unit_counts(sets, whole["w"].to_numpy(), [np.asarray(x, np.int64) for x in whole["leads"]], across)
        return [(d[i], n[i], d[j], n[j], None) for i, j in links] + [
            (d[i], n[i], None, None, int(counts[i])) for i in np.flatnonzero(counts).tolist()]

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["da", "na", "db", "nb", "w"], dtype=object).astype("Int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = [], None
        for b in batches:
            if not len(b):
                continue
            key = list(zip(*(b[c].tolist() for c in unit), strict=True))
            cut = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            out = []
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                if key[a] != at and held:
                    out += solve(held)
                    held = []
                at = key[a]
                held.append(b.iloc[a:z])
            yield frame(out)
        if held:
            yield frame(solve(held))
    found = rows.mapInPandas(run, "da long, na long, db long, nb long, w long")
    return found if counting else found.distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) of every row."""
    return _joined(docs, id_col, text_col, False)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id as ``jaccard_components``, and n_links: how many other rows link with the row (rows with the
    same set do, also those that repeat its id; rows without words link with none). Every linked pair of sets is evaluated."""
    return _joined(docs, id_col, text_col, True)


def _labelled(docs: DataFrame, id_col: str, text_col: str, counting: bool, tie: bool):
    """The sets of all rows (doc_id, digest, n), the component of each distinct set (_d, _n, root, component_id), the links' answers and the
    sets' weights. ``tie``: rows that repeat an id tie their sets together, as they are one document."""
    texts = _texts(docs, id_col, text_col)
    sets = stored(_sets(texts), "shingle-sets")
    members = stored(_under_leaders(texts, _order(texts)), "candidates")
    weights = stored(sets.filter("n > 0").groupBy("digest", "n").agg(F.count(F.lit(1)).alias("w")), "set-weights") if counting else None
    answers = stored(_linked_sets(texts, members, weights), "set-links")
    links = answers.filter("db is not null")
    # equal sets are one node: its smallest id; sets that only rows without id have get ids below all others
    nodes = sets.filter("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("first"))
    if not tie:  # an id that several sets have is no name for one of them
        shared = _repeated(sets).withColumnRenamed("doc_id", "first").withColumn("shared", F.lit(True))
        nodes = nodes.join(shared, "first", "left").withColumn("name", F.when(F.col("shared").isNull(), F.col("first")))
    else:
        nodes = nodes.withColumn("name", F.col("first"))
    nodes = stored(nodes.select("digest", "n", "first", F.coalesce("name", F.xxhash64("digest", "n")).alias("node")), "set-nodes")
    a = nodes.select(F.col("digest").alias("da"), F.col("n").alias("na"), F.col("node").alias("a"))
    b = nodes.select(F.col("digest").alias("db"), F.col("n").alias("nb"), F.col("node").alias("b"))
    pairs = links.join(a, ["da", "na"]).join(b, ["db", "nb"]).select("a", "b")
    if tie:
        pairs = pairs.unionByName(sets.filter("n > 0 and doc_id is not null").join(nodes, ["digest", "n"]).filter("doc_id <> node").join(
            _repeated(sets), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    least = nodes.join(connected_components(pairs), "node", "left").withColumn("root", F.coalesce("component", "node"))
    known = least.groupBy("root").agg(F.min("first").alias("component_id"))
    label = least.join(known, "root").select(F.col("digest").alias("_d"), F.col("n").alias("_n"), "root", "component_id")
    return sets, label, answers, weights


def _joined(docs: DataFrame, id_col: str, text_col: str, counting: bool) -> DataFrame:
    sets, label, answers, weights = _labelled(docs, id_col, text_col, counting, tie=True)
    rows = sets.join(label, (F.col("digest") == F.col("_d")) & (F.col("n") == F.col("_n")), "left")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")]
    if not counting:
        return rows.select(*columns)
    linked_weight = answers.filter("db is null").groupBy("da", "na").agg(F.sum("w").alias("others"))
    totals = weights.join(linked_weight, (F.col("digest") == F.col("da")) & (F.col("n") == F.col("na")), "left").select(
        F.col("digest").alias("_td"), F.col("n").alias("_tn"), (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("_links"))
    rows = rows.join(totals, (F.col("digest") == F.col("_td")) & (F.col("n") == F.col("_tn")), "left")
    return rows.select(*columns, F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"))


def _repeated(sets: DataFrame) -> DataFrame:
    return sets.groupBy("doc_id").count().filter("count > 1").select("doc_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, that with the smallest id (a row without an id only where none has one); rows without words all stay.
    An id that several rows have does not make them copies: they are told apart by their texts, of equal ones a
    single row stays. Columns as they were."""
    sets, label, _, _ = _labelled(docs, id_col, text_col, False, tie=False)
    placed = sets.join(label, (F.col("digest") == F.col("_d")) & (F.col("n") == F.col("_n")))
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "n")).alias("w"))
    name, digest_, n_, one = (free_name(docs, x) for x in ("_kept_id", "_digest", "_n", "_row"))
    kept = stored(first.select("w.doc_id", "w.digest", "w.n").unionByName(sets.filter("n = 0").select("doc_id", "digest", "n").distinct()), "kept-sets")
    # an id of a single row says which row is meant; the others' texts are looked at again
    shared = stored(_repeated(sets).filter("doc_id is not null").select(F.col("doc_id").alias(name), F.lit(True).alias(one)), "shared-ids")
    own = F.col(id_col).cast("long")
    if shared.isEmpty() and sets.filter("doc_id is null").isEmpty():  # every id says which row is meant
        return docs.join(kept.select(F.col("doc_id").alias(name)), own == F.col(name), "left_semi")
    flagged = docs.join(shared, own == F.col(name), "left").drop(name)
    unsure = F.coalesce(F.col(one), F.col(id_col).isNull())
    sure = flagged.filter(~unsure).drop(one).join(kept.select(F.col("doc_id").alias(name)), own == F.col(name), "left_semi")

    @F.pandas_udf("digest long, n long")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = shingle_sets([t if isinstance(t, str) else "" for t in texts], WORDS)
        return pd.DataFrame({"digest": [digest(x) for x in found], "n": [len(x) for x in found]})
    told = flagged.filter(unsure).drop(one).withColumn(digest_, of(F.col(text_col).cast("string"))).withColumn(n_, F.col(digest_)["n"])
    told = told.withColumn(digest_, F.col(digest_)["digest"])
    sought = kept.select(F.col("doc_id").alias("_a"), F.col("digest").alias("_b"), F.col("n").alias("_c")).alias("k")
    told = told.join(sought, own.eqNullSafe(F.col("k._a")) & (F.col(digest_) == F.col("k._b")) & (F.col(n_) == F.col("k._c")), "left_semi")
    at = Window.partitionBy(id_col, digest_, n_).orderBy(F.length(text_col).desc_nulls_last(), text_col)
    wordless, rest = told.filter(F.col(n_) == 0), told.filter(F.col(n_) > 0)
    rest = rest.withColumn(one, F.row_number().over(at)).filter(F.col(one) == 1).drop(one)
    return sure.unionByName(wordless.unionByName(rest).drop(digest_, n_))
