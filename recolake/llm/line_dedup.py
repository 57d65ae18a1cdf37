"""Reversible line deduplication: exact reference counts with sharded cuckoo filters in front.

State, in the folder given, as generations of plain Parquet tables that hold what an insertion or deletion changes:

* ``refs``: one row per document and distinct long line of it (shard, k1, k2, doc_id): the exact
  references; ``gone``: deleted ids, which end all their references of earlier generations, so the state is that without the document.
* ``counts``: per touched line key its reference count and the largest doc_id (shard, k1, k2, n_docs, max_doc); the last generation's row holds.
* ``filters``: per touched shard one cuckoo filter of the keys that reach the drop threshold.

An insertion writes in proportion to its documents, never to the index; every ``COMPACT`` generations all is folded into one.

A line's shard comes from its hash. A generation touches a shard's filter only where keys cross the
threshold: inserted on the way up, deleted on the way down. To mark lines, references are
probed against the filters and only the few that pass are joined with the exact counts.

Defined results: a null or empty text is one empty line; only ``\\n`` ends a line; a key is the line
stripped of ASCII white space with A-Z lower-cased, and 128 bits of BLAKE2b stand for it. A row is a
document: rows that repeat a doc_id count one reference each, and all of them keep the line where that doc_id is the
largest. Rows with a null doc_id are counted, and keep a line only where no id is known. An empty table
gives an empty result; other columns are carried by ``dedup_lines`` and never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITESPACE, scratch_path, stored
from .cuckoo import CuckooFilter, build

MIN_CHARS = 40
MIN_DOCS = 5
# filters are sent to all tasks up to this many bytes; beyond it each goes with its shard's references
FILTER_BYTES = 64 << 20
PROBE_REFS = 1_000_000  # of a shard that meet its filter in one task
COMPACT = 32  # generations after which everything is written anew

_LOWER = {c: c + 32 for c in range(65, 91)}
_KEY = ["shard", "k1", "k2"]
_REFS = "shard int, k1 long, k2 long, doc_id long"
_COUNTS = "shard int, k1 long, k2 long, n_docs long, max_doc long"


def line_key(line: str) -> str:
    return line.strip(WHITESPACE).translate(_LOWER)


def _digest(key: str) -> bytes:
    return blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _shard_of(k1, shards: int):
    return (np.asarray(k1).astype(np.int64) >> 20) % shards


def references(docs: DataFrame, shards: int, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """shard, k1, k2, doc_id: the distinct long lines of every row."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = {_digest(k) for k in map(line_key, (text or "").split("\n")) if len(k) >= min_chars}
                keys += seen
                ids += [doc] * len(seen)
            k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_shard_of(k[:, 0], shards).astype(np.int32)), pa.array(np.ascontiguousarray(k[:, 0])),
                 pa.array(np.ascontiguousarray(k[:, 1])), pa.array(ids, pa.int64())],
                names=["shard", "k1", "k2", "doc_id"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(extract, "shard int, k1 long, k2 long, doc_id long")


def _count(refs: DataFrame) -> DataFrame:
    """Per key the references and the largest id; combined on the map side, so a hot line is one row per task."""
    return refs.groupBy("shard", "k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))


class LineIndex:
    """The persistent state: ``insert`` and ``delete`` documents, ``dropped`` lines of references."""

    def __init__(self, spark: SparkSession, path: str, shards: int = 64, min_docs: int = MIN_DOCS,
                 min_chars: int = MIN_CHARS):
        self.spark, self.path, self.shards, self.min_docs, self.min_chars = spark, path.rstrip("/"), shards, min_docs, min_chars
        self.generation = self._last()

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _last(self) -> int:
        g = 0
        while self._exists(f"{self.path}/g{g + 1}/filters/_SUCCESS"):
            g += 1
        return g

    def _at(self, table: str, generation: int | None = None) -> str:
        return f"{self.path}/g{self.generation if generation is None else generation}/{table}"

    def _read(self, table: str, schema: str) -> DataFrame | None:
        """A table of all generations since the last full one; the column gen says which a row is from."""
        first = max(1, self.generation - self.generation % COMPACT)
        paths = [p for g in range(first, self.generation + 1) if self._exists(p := self._at(table, g))]
        return self.spark.read.schema(f"{schema}, gen int").parquet(*paths) if paths else None

    def _latest(self, table: str, schema: str, keys: list[str], values: list[str]) -> DataFrame:
        """Of every key the row of its last generation."""
        rows = self._read(table, schema)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        if self.generation - self.generation % COMPACT >= self.generation or self.generation == 1:
            return rows.drop("gen")
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "gen").alias("v")).select(*keys, "v.*")

    def refs(self) -> DataFrame:
        """All references of documents that are there."""
        rows, gone = self._read("refs", _REFS), self._read("gone", "doc_id long")
        if rows is None:
            return self.spark.createDataFrame([], _REFS)
        if gone is not None:
            dead = gone.groupBy("doc_id").agg(F.max("gen").alias("until"))
            rows = rows.alias("r").join(dead.alias("d"), F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("r.gen") < F.col("d.until")), "left_anti")
        return rows.select("shard", "k1", "k2", "doc_id")

    def counts(self) -> DataFrame:
        return self._latest("counts", _COUNTS, _KEY, ["n_docs", "max_doc"]).filter("n_docs > 0").select(*_KEY, "n_docs", "max_doc")

    def filters(self) -> DataFrame:
        return self._latest("filters", "shard int, filter binary", ["shard"], ["filter"]).select("shard", "filter")

    def _next(self) -> int:
        """The number of the next generation. Numbers divisible by COMPACT hold everything anew, the others what changed."""
        g = self.generation + 1
        if g % COMPACT == 0:
            tagged = F.lit(g).alias("gen")
            for table, rows in (("refs", self.refs()), ("counts", self.counts()), ("filters", self.filters())):
                rows.select("*", tagged).write.parquet(self._at(table, g), mode="overwrite")
            self.generation = g
            g += 1
        return g

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add the rows' references; counts and filters of the keys and shards that they touch are written, no others."""
        g = self._next()
        (references(docs, self.shards, self.min_chars, id_col, text_col).withColumn("gen", F.lit(g))
         .write.parquet(self._at("refs", g), mode="overwrite"))
        added = _count(self.spark.read.schema(f"{_REFS}, gen int").parquet(self._at("refs", g)))
        if not self.generation:
            self._advance(g, None, added)
            return
        old = self._touched(added)
        merged = added.alias("a").join(old.alias("o"), _KEY, "left").select(
            *_KEY, (F.col("a.n_docs") + F.coalesce("o.n_docs", F.lit(0))).alias("n_docs"), F.greatest("a.max_doc", "o.max_doc").alias("max_doc"))
        self._advance(g, old, merged)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Remove all references of the documents with these ids: the state is as if they had never come. The ids are written, and the
        counts of the keys that they held, counted anew from what is left."""
        g = self._next()
        gone = stored(ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "line-gone")
        lost = self.refs().alias("r").join(gone.alias("d"), F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")), "left_semi")
        keys = stored(lost.select(*_KEY).distinct(), "line-keys")
        old = self._touched(keys)
        left = self.refs().alias("r").join(gone.alias("d"), F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")), "left_anti")
        counted = keys.join(_count(left.join(keys, _KEY, "left_semi")), _KEY, "left").select(
            *_KEY, F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "max_doc")
        gone.withColumn("gen", F.lit(g)).write.parquet(self._at("gone", g), mode="overwrite")
        self._advance(g, old, counted)

    def _touched(self, keys: DataFrame) -> DataFrame:
        return stored(self.counts().join(keys.select(*_KEY), _KEY, "left_semi"), "line-counts")

    def _advance(self, g: int, old: DataFrame | None, new: DataFrame) -> None:
        """Write the touched keys' new counts, and the filters of the shards where a key crosses the threshold."""
        new.select(*_KEY, "n_docs", "max_doc", F.lit(g).alias("gen")).write.parquet(self._at("counts", g), mode="overwrite")
        new = self.spark.read.schema(f"{_COUNTS}, gen int").parquet(self._at("counts", g))
        over = F.col("n_docs") >= self.min_docs
        if old is None:
            moved = new.filter(over).select("shard", "k1", F.lit(True).alias("up"))
        else:
            before = old.filter(over).select(*_KEY, F.lit(True).alias("was"))
            moved = (new.join(before, _KEY, "left").withColumn("up", over)
                     .filter(F.col("up") != F.coalesce("was", F.lit(False))).select("shard", "k1", "up"))
        moved = stored(moved, "line-moved")
        mine = self.filters().join(moved.select("shard").distinct(), "shard", "left_semi")
        # written before they are read twice: a lost executor must not make them anew, in another order of rows
        filters = stored(moved.groupBy("shard").cogroup(mine.groupBy("shard")).applyInPandas(_crossed, "shard int, filter binary, grow boolean"), "line-filters")
        full = filters.filter("grow").select("shard")
        tagged = F.lit(g).alias("gen")
        if full.isEmpty():
            rebuilt = filters.limit(0).select("shard", "filter")
        else:
            # a filter that overflows is built again from the exact counts
            now = self.counts().join(new.select(*_KEY), _KEY, "left_anti").unionByName(new.drop("gen")).filter(over)
            rebuilt = now.join(full, "shard", "left_semi").select("shard", "k1").groupBy("shard").applyInPandas(_rebuilt, "shard int, filter binary")
        (filters.filter("not grow").select("shard", "filter").unionByName(rebuilt).select("*", tagged)
         .write.parquet(self._at("filters", g), mode="overwrite"))
        self.generation = g

    def dropped(self, refs: DataFrame | None = None) -> DataFrame:
        """doc_id, lines (array of k1): the lines that each document loses. By default of all references."""
        refs = self.refs() if refs is None else refs
        sizes = self.filters().agg(F.sum(F.length("filter"))).first()[0] or 0
        if sizes <= FILTER_BYTES:
            refs = _probed(refs, {r.shard: bytes(r.filter) for r in self.filters().toLocalIterator()}, self.shards)
        else:
            refs = _probed_by_shard(refs, self.filters(), self.shards)
        heavy = self.counts().filter(F.col("n_docs") >= self.min_docs).select("k1", "k2", "max_doc")
        return (refs.join(heavy, ["k1", "k2"]).filter(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
                .groupBy("doc_id").agg(F.collect_set("k1").alias("lines")))


def _crossed(moved, old):
    """One shard: its filter after keys crossed the threshold upwards (insert) or downwards (delete)."""
    import pandas as pd
    shard = int((moved if len(moved) else old)["shard"].iloc[0])
    up = moved["up"].to_numpy(bool) if len(moved) else np.zeros(0, bool)
    keys = moved["k1"].to_numpy(np.int64) if len(moved) else np.zeros(0, np.int64)
    grow = False
    if len(old):
        f = CuckooFilter.load(old["filter"].iloc[0])
        f.delete(keys[~up])
        grow = not f.insert(keys[up])
    else:
        f = build(keys[up])
    return pd.DataFrame({"shard": [shard], "filter": [f.dump()], "grow": [grow]})


def _rebuilt(heavy):
    import pandas as pd
    return pd.DataFrame({"shard": heavy["shard"].iloc[:1], "filter": [build(heavy["k1"].to_numpy(np.int64)).dump()]})


def _probed_by_shard(refs: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The references that their shard's filter holds. Where all filters together are too large to be sent to every task, each
    goes with its shard's references, which are dealt out in parts of about ``PROBE_REFS``."""
    parts = max(1, -(-refs.count() // (shards * PROBE_REFS)))
    dealt = refs.withColumn("part", F.pmod(F.xxhash64("doc_id", "k1"), F.lit(parts)))
    sent = filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def probe(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows = rows.select(["shard", "k1", "k2", "doc_id"])
        if not rows.num_rows or not own.num_rows:
            return rows.slice(0, 0)
        hit = CuckooFilter.load(own["filter"][0].as_py()).contains(rows["k1"].to_numpy())
        return rows.filter(pa.array(hit))
    return dealt.groupBy("shard", "part").cogroup(sent.groupBy("shard", "part")).applyInArrow(probe, "shard int, k1 long, k2 long, doc_id long")


def _probed(refs: DataFrame, filters: dict[int, bytes], shards: int) -> DataFrame:
    sent = refs.sparkSession.sparkContext.broadcast(filters)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = {s: CuckooFilter.load(raw) for s, raw in sent.value.items()}
        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            k1 = batch.column("k1").to_numpy(zero_copy_only=False)
            hit = np.zeros(len(k1), bool)
            order = np.argsort(shard, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(part) and int(shard[part[0]]) in loaded:
                    hit[part] = loaded[int(shard[part[0]])].contains(k1[part])
            yield batch.filter(pa.array(hit))
    return refs.mapInArrow(probe, refs.schema)


def _strip(docs: DataFrame, index: LineIndex, id_col: str, text_col: str, carried: list[str], as_text: bool) -> DataFrame:
    """Join each row with its dropped lines and take them out of the text."""
    min_chars = index.min_chars
    side = index.dropped().select(F.col("doc_id").alias("_line_doc"), F.col("lines").alias("_lines"))
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text"),
                       *[F.col(c).alias(f"_c_{c}") for c in carried])
    joined = rows.join(side, F.col("_doc").eqNullSafe(F.col("_line_doc")), "left").drop("_line_doc")

    def take(text, drop):
        lines = (text or "").split("\n")
        kept = lines
        if drop:
            gone = set(drop)
            kept = [x for x in lines if len(k := line_key(x)) < min_chars or _first(k) not in gone]
        left = "\n".join(kept)
        if not as_text:
            left = sha256(left.encode("utf-8", "surrogatepass")).hexdigest()
        return len(lines), len(lines) - len(kept), None if as_text and text is None else left

    extra = [joined.schema[f"_c_{c}"] for c in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [take(t, d) for t, d in zip(batch.column("_text").to_pylist(), batch.column("_lines").to_pylist(), strict=True)]
            made = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), *made, *[batch.column(f.name) for f in extra]],
                                             names=["_doc", "_n_lines", "_n_dropped", "_kept", *[f.name for f in extra]])
    schema = "_doc long, _n_lines long, _n_dropped long, _kept string"
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)
    return joined.mapInArrow(run, schema)


def _first(key: str) -> int:
    return int.from_bytes(_digest(key)[:8], "little", signed=True)


def line_decisions(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept_sha256 for rows whose references the index holds."""
    return _strip(docs, index, id_col, text_col, [], False).select(
        F.col("_doc").alias("doc_id"), F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"), F.col("_kept").alias("kept_sha256"))


def dedup_lines(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns with the kept lines as text. A null text stays null."""
    carried = [c for c in docs.columns if c not in (id_col, text_col)]
    out = _strip(docs, index, id_col, text_col, carried, True)
    made = {id_col: F.col("_doc"), text_col: F.col("_kept")} | {c: F.col(f"_c_{c}") for c in carried}
    return out.select(*[made[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def new_index(docs: DataFrame, path: str | None = None, **settings) -> LineIndex:
    """An index of all rows, in the shared folder unless a path is given."""
    spark = docs.sparkSession
    index = LineIndex(spark, path or scratch_path(spark, "line-index"), **settings)
    index.insert(docs)
    return index
