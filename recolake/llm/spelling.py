"""Spelling variant grouping: words one edit apart, found by k-d trees over letter counts.

One inserted or deleted letter moves a word's vector of letter counts by one, one replaced letter by two: one count goes up, another
goes down. So the words near a word of length L are searched in the k-d tree of length L with one step up and one down, and in that of
length L + 1 with one step up; a branch is left out as soon as its box needs more steps than are left. What remains at
the leaves is compared by packed counts, and the letters of the survivors are verified in their order.

A length with many words has its upper levels, learned from a bounded sample, as cells: a word lies in one cell and is sent as a query to the
cells that its steps reach. The sample decides how evenly cells fill, never what is found. In a task a cell's tree is built and all its
queries go down together.

Defined results: null and repeated words of the input are added up by word, null words, empty words and null counts take no part; words of other letters
than ``LETTERS`` raise an error in their task; very long words are compared whole; ties of count go to the smaller word in
code-point order; an empty table gives an empty result; other columns are not read.

Bounds: a cell holds about ``CELL`` words up to ``MOST_CELLS`` cells a length, more beyond that. Words with equal counts
(anagrams) cannot be told apart by a tree; they are compared in blocks of bounded memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

# fixed values: the letters of a word after A-Z are lower-cased
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
RUN = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CELL = 50_000  # words of one task's tree
MOST_CELLS = 4_096  # per length
SAMPLE = 200_000  # words of one length that its cells are learned from
LEAF = 24
BLOCK = 1 << 20  # word pairs compared at once

_AT = np.full(256, 255, np.uint8)
_AT[LETTERS] = np.arange(len(LETTERS))


def letters(words: list[str], length: int) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)
    if (_AT[codes] == 255).any():
        raise ValueError("a word holds something else than LETTERS")
    return codes


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Per word the count of every letter, 255 at most: two counts never lie further apart than the true ones."""
    n, d = len(codes), len(LETTERS)
    out = np.empty((n, d), np.uint8)
    step = max(1, BLOCK // max(1, codes.shape[1]))
    for a in range(0, n, step):
        part = _AT[codes[a:a + step]]
        at = (np.arange(len(part), dtype=np.int64) * d)[:, None] + part
        out[a:a + step] = np.minimum(np.bincount(at.ravel(), minlength=len(part) * d), 255).reshape(-1, d)
    return out


def _packed(counts: np.ndarray) -> list[np.ndarray]:
    """Bits "at least one" and "at least two" of every letter, in three words: differing bits never exceed the L1 distance."""
    bits = np.packbits(np.concatenate((counts >= 1, counts >= 2), axis=1), axis=1)
    return list(np.pad(bits, ((0, 0), (0, 24 - bits.shape[1]))).view(np.uint64).T.copy())


def _split(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter and bound that halve these points best: counts of at most the bound on one side, more on the other."""
    bound = counts.mean(axis=0).astype(np.uint8)
    share = (counts > bound).mean(axis=0)
    d = int(np.abs(share - 0.5).argmin())
    return (d, int(bound[d])) if 0 < share[d] < 1 else None


def _sides(c: np.ndarray, bound: int, up: np.ndarray, down: np.ndarray):
    """For counts c of queries that have steps left: per side the mask of those that reach it, and what steps they have then."""
    low = c <= bound
    fall, rise = (c == bound + 1) & down, (c == bound) & up
    return (low | fall, up, down & ~fall), (~low | rise, up & ~rise, down)


@dataclass(frozen=True)
class Cells:
    """The upper levels of the tree of one length: inner nodes (letter, bound, left, right), a negative child -1 - k is cell k."""
    nodes: tuple[tuple[int, int, int, int], ...] = ()

    @classmethod
    def learn(cls, counts: np.ndarray, cells: int) -> Cells:
        nodes: list[tuple[int, int, int, int]] = []
        made = 0

        def build(rows: np.ndarray) -> int:
            nonlocal made
            cut = _split(rows) if len(rows) > max(1, len(counts) // max(1, cells)) else None
            if cut is None:
                made += 1
                return -made
            at = len(nodes)
            nodes.append((0, 0, 0, 0))
            more = rows[:, cut[0]] > cut[1]
            nodes[at] = (*cut, build(rows[~more]), build(rows[more]))
            return at

        build(counts)
        return cls(tuple(nodes))

    def reach(self, counts: np.ndarray, up: bool, down: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, rows) of all cells that rows reach with so many steps; without any step the cell where each row lies."""
        todo = [(0 if self.nodes else -1, np.arange(len(counts)), np.full(len(counts), up), np.full(len(counts), down))]
        while todo:
            at, rows, u, d = todo.pop()
            if not len(rows):
                continue
            if at < 0:
                yield -1 - at, rows
                continue
            letter, bound, *children = self.nodes[at]
            for child, (mask, u2, d2) in zip(children, _sides(counts[rows, letter], bound, u, d), strict=True):
                todo.append((child, rows[mask], u2[mask], d2[mask]))


def near_pairs(points: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (query, point) of all pairs that one edit parts. Points have the queries' length, or one letter more."""
    longer = points.shape[1] - queries.shape[1]
    counts, asked = letter_counts(points), letter_counts(queries)
    packed, sought = _packed(counts), _packed(asked)
    limit = 1 if longer else 2
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def verified() -> tuple[np.ndarray, np.ndarray]:
        q, p = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = []
        step = max(1, BLOCK * 8 // points.shape[1])
        for a in range(0, len(q), step):
            w, v = queries[q[a:a + step]], points[p[a:a + step]]
            if longer:
                head = np.cumprod(v[:, :-1] == w, axis=1).sum(axis=1)
                tail = np.cumprod((v[:, 1:] == w)[:, ::-1], axis=1).sum(axis=1)
                keep.append(head + tail >= w.shape[1])
            else:
                keep.append((w != v).sum(axis=1) == 1)
        mask = np.concatenate(keep) if keep else np.zeros(0, bool)
        return q[mask], p[mask]

    todo = [(np.arange(len(points)), np.arange(len(queries)), np.ones(len(queries), bool), np.full(len(queries), not longer))]
    while todo:
        p, q, up, down = todo.pop()
        if not len(q) or not len(p):
            continue
        cut = _split(own := counts[p]) if len(p) > LEAF else None
        if cut is not None:
            more = own[:, cut[0]] > cut[1]
            for side, (mask, u, d) in zip((p[~more], p[more]), _sides(asked[q, cut[0]], cut[1], up, down), strict=True):
                todo.append((side, q[mask], u[mask], d[mask]))
            continue
        for a in range(0, len(p), LEAF * 64):
            block = p[a:a + LEAF * 64]
            step = max(1, BLOCK // len(block))
            for b in range(0, len(q), step):
                part = q[b:b + step]
                apart = sum(np.bitwise_count(x[part][:, None] ^ y[block][None]) for x, y in zip(sought, packed, strict=True))
                i, j = np.nonzero(apart <= limit)
                found.append((part[i], block[j]))
                size += len(i)
                if size > BLOCK:
                    yield verified()
                    found, size = [], 0
    if found:
        yield verified()


def _cells_of(words: DataFrame, cell: int, sample: int) -> dict[int, Cells]:
    """The upper levels of the lengths that have more words than one cell takes."""
    sizes = {r.length: r["count"] for r in words.groupBy("length").count().filter(F.col("count") > cell).collect()}
    if not sizes:
        return {}
    out = {}
    for length, n in sorted(sizes.items()):
        cells = min(MOST_CELLS, -(-n // cell))
        rows = (words.filter(F.col("length") == length).select("word").orderBy(F.xxhash64("word"), "word")
                .limit(min(sample, 400 * cells)).collect())
        out[length] = Cells.learn(letter_counts(letters([r.word for r in rows], length)), cells)
    return out


_ROUTED = "length int, cell int, asked int, word string, n long"


def _routed(words: DataFrame, trees: dict[int, Cells]) -> DataFrame:
    """Every word once where it lies (asked null) and as a query (asked: its length) wherever its steps reach."""
    sent = words.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Cells()
        for batch in batches:
            lengths = batch["length"].to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                own = batch.take(pa.array(np.flatnonzero(lengths == length)))
                counts = letter_counts(letters(own["word"].to_pylist(), length))
                here, there = sent.value.get(length, plain), sent.value.get(length + 1, plain)
                home = np.empty(len(counts), np.int64)
                for cell, rows in here.reach(counts, False, False):
                    home[rows] = cell
                    yield _rows(own, rows, length, cell, None)
                for cell, rows in here.reach(counts, True, True):
                    yield _rows(own, rows[home[rows] != cell], length, cell, length)
                for cell, rows in there.reach(counts, True, False):
                    yield _rows(own, rows, length + 1, cell, length)

    def _rows(own: pa.RecordBatch, rows: np.ndarray, length: int, cell: int, asked: int | None) -> pa.RecordBatch:
        part, n = own.take(pa.array(rows)), len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, length, np.int32)), pa.array(np.full(n, cell, np.int32)),
             pa.nulls(n, pa.int32()) if asked is None else pa.array(np.full(n, asked, np.int32)), part["word"], part["n"]],
            names=["length", "cell", "asked", "word", "n"])

    return words.select("word", "n", "length").mapInArrow(run, _ROUTED)


def _cell_pairs(table: pa.Table) -> pa.Table:
    """All near pairs of one cell, seen from both words: word, other, other_n."""
    length = table["length"][0].as_py()
    asked = table["asked"].fill_null(-1).to_numpy()
    words, n = table["word"].combine_chunks(), table["n"].to_numpy()
    at = {k: np.flatnonzero(asked == k) for k in (-1, length, length - 1)}
    out: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
    if len(home := at[-1]):
        points = letters(words.take(pa.array(home)).to_pylist(), length)
        alike = np.concatenate((home, at[length]))
        for rows, size in ((alike, length), (at[length - 1], length - 1)):
            if not len(rows):  # also of words of one letter, which no shorter word is near
                continue
            queries = letters(words.take(pa.array(rows)).to_pylist(), size)
            for q, p in near_pairs(points, queries):
                a, b = rows[q], home[p]
                out.append((a, b))
                if size < length:  # the shorter word asked; the longer one has no search of its own for it
                    out.append((b, a))
    a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    return pa.table({"word": words.take(pa.array(a)), "other": words.take(pa.array(b)), "other_n": pa.array(n[b])})


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, other, other_n of all pairs that one edit parts, both ways; ``words`` has distinct (word, n)."""
    sized = words.withColumn("length", F.length("word"))
    routed = _routed(sized, _cells_of(sized, cell, sample))
    return routed.groupBy("length", "cell").applyInArrow(_cell_pairs, "word string, other string, other_n long")


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """word, root from (word, form): forms followed to the last one, at most ``steps`` long; each round doubles the way."""
    now = stored(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")
    return now


def variants(words: DataFrame, ratio: int = 10, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, n, n_near, form, form_n, root from (word, n).

    form: the near word of largest n, if that is at least ``ratio`` (over 1) times the word's own; root: the last of the forms from the word on."""
    if ratio < 2:
        raise ValueError("a form must be commoner than its word")
    own = stored(words.filter("word <> '' and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    best = near_words(own, cell, sample).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    close = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    rows = stored(own.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(close, F.col("best.other")).alias("form"), F.when(close, -F.col("best.less")).alias("form_n")), "variants")
    most = rows.agg(F.max("n"), F.min("n")).first()
    steps = int(math.log(max(1, most[0] or 1) / max(1, most[1] or 1), ratio)) + 1
    last = roots(rows.filter("form is not null"), steps)
    return rows.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def slipped_runs(docs: DataFrame, every: int, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word: the letter runs of whole texts with A-Z lower-cased, of which those whose crc32 of ``<id>:<run>`` is divisible by ``every`` lose
    the letter at crc32 modulo length; words under ``least`` letters are left out. Null texts have none, a null id counts as empty."""
    run = F.explode(F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), F.lit(f"([{RUN}]{{{least},}})"), F.lit(1)))
    h = F.crc32(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))).otherwise(F.col("run"))
    return (docs.select(F.col(id_col), run.alias("run")).select("run", h.alias("h")).select(word.alias("word"))
            .filter(F.length("word") >= least))


def word_counts(words: DataFrame, least: int = 1) -> DataFrame:
    """word, n of the words that occur at least so often."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
