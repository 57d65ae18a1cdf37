"""Conversation prefix trie: sparse-table range minima over the sorted conversations' common prefixes.

Conversations become sequences of turn digests. Equal sequences are one; the distinct ones are range-sorted over the cluster, and in every range
the length of the common prefix (LCP) with the sequence before is known, over the range's border as well. Each prefix that a sequence is the first to have is a candidate
node. It finds its members alone: two binary searches over a sparse table of minima give how far to the left and to the right all LCPs reach its depth.
No stack is kept, so all candidates of a range are searched at once as arrays. Members, children, leaves and bytes of an interval are
differences of prefix sums; a prefix that reaches over the border of its range is added up from its parts, which are few: a border has one path
on each side.

Defined results: a null role or text counts as empty; turns are ordered by turn, null first, equal ones by digest; rows without a conv_id
belong to no conversation; repeated turns are turns each; very long texts are digested in the JVM and never leave it; an empty table has no nodes;
other columns are not read.

Bounds: a conversation is one row of 36 bytes a turn and fits into a task, as a text does. The members' ids of one sequence are
hashed in their order, which one task does as a stream (SHA-256 cannot be split), in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

STEP = 16  # bytes of a turn's digest
RANGE_TURNS = 100_000  # turns of one range
NO_MEMBERS = hashlib.sha256(b"").hexdigest()

_NODE = ("depth long, node binary, parent binary, parent_conv_id long, conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string")


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, steps: per conversation its turns in order, as structs of a digest of role and text (hex) and the text's bytes."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"))
    return (turns.select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), digest.alias("digest"),
                                                                             F.octet_length(t).cast("long").alias("size")).alias("s"))
            .filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("steps"))
            .select("conv_id", F.transform("steps", lambda s: F.struct(s["digest"].alias("digest"), s["size"].alias("size"))).alias("steps")))


def grafted(convs: DataFrame, base, length, longest: int) -> DataFrame:
    """Conversations whose first ``length`` steps (at most ``longest``) come from the conversation ``base`` (all it has, if fewer; none, if there
    is no such conversation), followed by their own steps after that many."""
    convs = stored(convs.withColumns({"_base": base, "_length": length}), "conversations")
    heads = (convs.join(convs.select(F.col("_base").alias("conv_id")).distinct(), "conv_id", "left_semi")
             .select(F.col("conv_id").alias("_base"), F.slice("steps", 1, longest).alias("_head")))
    none = F.slice("steps", 1, 0)
    steps = F.concat(F.coalesce(F.slice("_head", F.lit(1), F.col("_length")), none),
                     F.when(F.size("steps") > F.col("_length"), F.slice("steps", F.col("_length") + 1, F.size("steps"))).otherwise(none))
    return convs.join(heads, "_base", "left").select("conv_id", steps.alias("steps"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, conv_id): per key its number of members, the smallest and the hash of all, as they stream by."""
    key, first, n, sha = None, 0, 0, hashlib.sha256()
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, ends = batch["conv_id"].to_pylist(), pc.run_end_encode(batch["key"])
        done, a = [], 0
        for k, b in zip(ends.values.to_pylist(), ends.run_ends.to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((first, n, sha.hexdigest()))
                key, first, n, sha = k, ids[a], 0, hashlib.sha256()
            sha.update(((b"," if n else b"") + ",".join(map(str, ids[a:b])).encode()))
            n += b - a
            a = b
        yield _members(done)
    if key is not None:
        yield _members([(first, n, sha.hexdigest())])


def _members(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)],
                                      names=["conv_id", "n", "ends"])


def sequences(convs: DataFrame) -> DataFrame:
    """path (the digests joined), sizes, conv_id (smallest member), n, ends: the distinct sequences of (conv_id, steps)."""
    own = stored(convs.select("conv_id", F.unhex(F.array_join(F.transform("steps", lambda s: s["digest"]), "")).alias("path"),
                              F.transform("steps", lambda s: s["size"]).alias("sizes")), "paths")
    keyed = own.select(F.unhex(F.sha2("path", 256)).alias("key"), "conv_id")
    members = keyed.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_runs, "conv_id long, n long, ends string")
    return own.join(members, "conv_id")


def _common(a: bytes | None, b: bytes | None) -> int:
    """Steps that two paths share; -1 if one of them does not exist."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    apart = np.flatnonzero(x != y)
    return int(apart[0] if len(apart) else n) // STEP


def _prefix_digests(path: bytes) -> np.ndarray:
    """A digest of every prefix of a path, the empty one first."""
    h, out = hashlib.sha256(), []
    for a in range(0, len(path) + 1, STEP):
        out.append(h.copy().digest())
        h.update(path[a:a + STEP])
    return np.array(out, object)


class Minima:
    """Sparse table: the least value of any range of an array."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (half := 1 << (len(self.levels) - 1)) <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of values[a..b], b included."""
        k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.levels[0].dtype)
        for level in np.unique(k).tolist():
            m = k == level
            t = self.levels[level]
            out[m] = np.minimum(t[a[m]], t[b[m] - (1 << level) + 1])
        return out

    def extents(self, at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per position the first and the last one up to which all values between neighbours (values[i] lies between i - 1 and i) are at
        least ``least``; both are found by binary search alone."""
        left, right, n = at.copy(), at.copy(), len(self.levels[0])
        for level in range(len(self.levels) - 1, -1, -1):
            t, size = self.levels[level], 1 << level
            ok = np.flatnonzero(right + size < n)
            go = ok[t[right[ok] + 1] >= least[ok]]
            right[go] += size
            ok = np.flatnonzero(left - size >= 0)
            go = ok[t[left[ok] - size + 1] >= least[ok]]
            left[go] -= size
        return left, right


def _lcp(steps: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Per sequence after the first the number of steps shared with the one before."""
    length = np.diff(offset)
    shared = np.minimum(length[:-1], length[1:])
    pair = np.repeat(np.arange(len(shared)), shared)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(shared) - shared, shared)
    apart = np.flatnonzero((steps[offset[pair] + at] != steps[offset[pair + 1] + at]).any(axis=1))
    np.minimum.at(shared, pair[apart], at[apart])
    return shared


def range_nodes(paths: list[bytes], sizes: np.ndarray, convs: np.ndarray, n: np.ndarray, ends: list[str], before: bytes | None,
                after: bytes | None) -> dict[str, list | np.ndarray]:
    """The nodes of sorted distinct paths between the neighbours ``before`` and ``after``; ``sizes`` are the bytes of all steps in order.
    Nodes that a neighbour shares hold this range's part and have a digest."""
    m = len(paths)
    length = np.fromiter(map(len, paths), np.int64, m) // STEP
    offset = np.concatenate(([0], np.cumsum(length)))
    steps = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, STEP // 8)
    lcp = np.concatenate(([_common(before, paths[0])], _lcp(steps, offset))).astype(np.int64)
    beyond = _common(paths[-1], after)
    table, least_conv = Minima(lcp), Minima(convs)
    total = np.concatenate(([0], np.cumsum(sizes)))

    # candidates: every prefix that a sequence is the first of this range to have
    new = np.where(np.arange(m) == 0, -1, lcp)
    count = length - new
    row = np.repeat(np.arange(m), count)
    depth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + new[row] + 1
    left, right = table.extents(row, depth)
    up_left, up_right = table.extents(row, depth - 1)

    shared_left, shared_right = (left == 0) & (lcp[0] >= depth), (right == m - 1) & (beyond >= depth)
    up_shared_left, up_shared_right = (up_left == 0) & (lcp[0] >= depth - 1), (up_right == m - 1) & (beyond >= depth - 1)

    def added(values: np.ndarray) -> np.ndarray:
        s = np.concatenate(([0], np.cumsum(values)))
        return s[right + 1] - s[left]

    def bytes_to(rows: np.ndarray, d: np.ndarray) -> np.ndarray:
        return total[offset[rows] + d] - total[offset[rows]]

    members = added(n)
    alone = np.append(lcp[1:], beyond) < length
    whole = bytes_to(np.arange(m), length)
    # bytes of the nodes that each sequence is the first to have; the first sequence of an interval has more in it than its own
    own = whole - bytes_to(np.arange(m), np.maximum(lcp, 0))
    above = bytes_to(row, np.maximum(depth - 1, 0))
    own_here = added(own) + np.where(shared_left, 0, whole[left] - above - own[left])
    order = np.sort(lcp[1:] * m + np.arange(1, m))
    between = np.searchsorted(order, depth * m + right, "right") - np.searchsorted(order, depth * m + left, "right")
    begins = np.where(shared_left, lcp[0] == depth, length[left] > depth)

    first, last = _prefix_digests(paths[0]), _prefix_digests(paths[-1])

    def digests(by_left: np.ndarray, by_right: np.ndarray, d: np.ndarray) -> np.ndarray:
        out = np.full(len(d), None, object)
        out[by_right] = last[d[by_right]]
        out[by_left] = first[d[by_left]]
        return out

    root = depth == 0
    parent = digests(up_shared_left & ~root, up_shared_right & ~root, depth - 1)
    parent_conv = np.full(len(depth), None, object)
    inner = ~(up_shared_left | up_shared_right | root)
    parent_conv[inner] = least_conv.of(up_left, up_right)[inner]
    ended = np.full(len(depth), None, object)
    here = (length[left] == depth) & ~shared_left
    ended[here] = np.array(ends, object)[left[here]]
    return {"depth": depth, "node": digests(shared_left, shared_right, depth), "parent": parent, "parent_conv_id": parent_conv,
            "conv_id": least_conv.of(left, right), "n_convs": members, "n_children": between + begins, "n_leaves": added(alone),
            "saved_tokens": added(n * whole) - members * above - own_here, "ends_sha256": ended}


_NODE_TYPES = {"node": pa.binary(), "parent": pa.binary(), "ends_sha256": pa.string()}


def _range(rows: pa.Table, border: pa.Table) -> pa.Table:
    if not rows.num_rows:
        names = [x.split()[0] for x in _NODE.split(", ")]
        return pa.table({x: pa.array([], _NODE_TYPES.get(x, pa.int64())) for x in names})
    rows = rows.sort_by("path")
    found = range_nodes(rows["path"].to_pylist(), rows["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False), rows["conv_id"].to_numpy(),
                        rows["n"].to_numpy(), rows["ends"].to_pylist(), border["before"][0].as_py(), border["after"][0].as_py())
    return pa.table({k: pa.array(v, _NODE_TYPES.get(k, pa.int64())) for k, v in found.items()})


def trie(convs: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """The nodes of the prefix trie of (conv_id, steps): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    seqs = stored(sequences(convs), "sequences")
    turns = seqs.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    ranges = max(1, -(-turns // range_turns))
    placed = stored(seqs.repartitionByRange(ranges, "path").withColumn("part", F.spark_partition_id()), "ranges")
    # one row a range: what its neighbours begin and end with
    in_order = Window.orderBy("part")
    borders = (placed.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
               .select("part", F.lag("last").over(in_order).alias("before"), F.lead("first").over(in_order).alias("after")))
    nodes = stored(placed.groupBy("part").cogroup(borders.groupBy("part")).applyInArrow(_range, _NODE), "nodes")

    shared = nodes.filter("node is not null").groupBy("node").agg(
        F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends_sha256").alias("ends_sha256"))
    shared = stored(shared, "shared-nodes")
    every = nodes.filter("node is null").drop("node").unionByName(shared.drop("node").withColumn("parent_conv_id", F.lit(None).cast("long")))
    above = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    return every.join(above, "parent", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"))
