"""A stored search index and exact block-max retrieval.

The index job lays the documents out in blocks of ``BLOCK_DOCS`` and writes, per (field, term, block), one row with the
block's documents, their term-frequency factors and the largest of these. The table is partitioned by field and a hash bucket of
the term, so a query reads the buckets of its terms. Term counts and collection statistics are tables of their own; what
depends on them (idf) is multiplied in at query time.

A query never meets a document before its block was cut: query terms join the blocks' largest factors, which bounds the score of every
(query, block) pair. The blocks with the best bounds are scored first and give each query a score to beat; of
the others only those whose bound can still change the answer are scored. A scored block returns its best ``num`` documents.
The answer is that of scoring everything, ties included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import scratch_folder
from .fuzzy import fuzzy_expansions
from .popular import top_k_per_key

K1, B = 1.2, 0.75
BLOCK_DOCS = 1024
BUCKETS = 16  # of terms, per field; more for a larger vocabulary
SEED_BLOCKS = 4  # scored first for every query
DIGITS = 9  # scores that agree so far are ties


def _text(df: DataFrame, field: str) -> Column:
    """A text column, or the elements of an array one after the other."""
    return F.array_join(field, " ") if dict(df.dtypes)[field].startswith("array") else F.col(field)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def build_index(docs: DataFrame, path: str, fields, block_docs: int = BLOCK_DOCS, buckets: int = BUCKETS) -> str:
    """Index job over documents (item_id, the fields); writes below ``path`` and returns it."""
    spark = docs.sparkSession
    for field, _, _ in fields:
        if field not in docs.columns:
            raise ValueError(f"the documents have no field {field!r}; pass the fields to search")
    # documents that are alike share a block, which makes the bounds tight; the id splits equal ones
    order = [f for f, _, kind in fields if kind == "keyword"] + [f for f, _, kind in fields if kind == "text"][:1]
    order = [o for o in order if not dict(docs.dtypes)[o].startswith("array")] + ["item_id"]
    placed = docs.select("item_id", *(f for f, _, _ in fields)).repartitionByRange(*order).sortWithinPartitions(*order)
    placed.withColumn("block", F.floor(F.monotonically_increasing_id() / block_docs)).write.parquet(f"{path}/docs")
    placed = spark.read.parquet(f"{path}/docs")

    # a document "has" a text field when the field yields a token, so empty texts count neither in n nor in the mean length
    sizes = [F.nullif(F.size(tokens(_text(placed, f))), F.lit(0)).alias(f) for f, _, kind in fields if kind == "text"]
    stats = placed.select(*sizes).agg(F.lit(0).alias("_"), *(F.avg(f).alias(f) for f, _, kind in fields if kind == "text")).first()
    postings = None
    for field, _, kind in fields:
        if kind == "keyword":
            rows = placed.filter(F.col(field).isNotNull()).select("block", "item_id", F.col(field).alias("term"), F.lit(1.0).alias("factor")).repartition("block")
        else:
            # blocks are dealt out whole: counting a document's terms and gathering a block's needs no further shuffle
            # texts are dealt, not their words, which take twice the room
            rows = (placed.select("block", "item_id", _text(placed, field).alias("_x")).repartition("block")
                    .select("block", "item_id", tokens("_x").alias("_t"))
                    .select("block", "item_id", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
                    .groupBy("block", "item_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
            rows = rows.select("block", "item_id", "term", (F.col("tf") * (K1 + 1) / (
                F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(stats[field] or 1.0)))).alias("factor"))
        rows = rows.groupBy("block", "term").agg(F.sort_array(F.collect_list(F.struct("item_id", "factor"))).alias("p"))
        rows = rows.select("term", "block", F.col("p.item_id").alias("items"), F.col("p.factor").alias("factors"),
                           F.array_max("p.factor").alias("top"), F.lit(field).alias("field"), _bucket(buckets).alias("bucket"))
        postings = rows if postings is None else postings.unionByName(rows)
    (postings.repartition("field", "bucket", F.pmod("block", F.lit(8))).sortWithinPartitions("term", "block")
     .write.partitionBy("field", "bucket").parquet(f"{path}/postings"))
    counts = _postings(spark, path).groupBy("field", "term").agg(F.sum(F.size("items")).alias("df"))
    counts.write.parquet(f"{path}/terms")
    n = placed.select(*sizes, *(F.col(f) for f, _, kind in fields if kind == "keyword")).agg(
        *(F.count(f).alias(f) for f, _, _ in fields))
    n.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f, _, _ in fields))).alias("s")).select(
        "s.*", F.lit(buckets).alias("buckets")).write.parquet(f"{path}/fields")
    return path


def _postings(spark: SparkSession, path: str) -> DataFrame:
    """Stated, as an index of no documents has no files to read it from: the schema of the postings."""
    item = spark.read.parquet(f"{path}/docs").schema["item_id"].dataType.simpleString()
    return spark.read.schema(f"term string, block bigint, items array<{item}>, factors array<double>, top double, field string, bucket int").parquet(
        f"{path}/postings")


def _query_terms(spark: SparkSession, path: str, queries: DataFrame, fields, fuzzy: bool) -> DataFrame:
    """query, field, pos, term, w: every term of the index that a query asks for, with all of its score but the document's factor."""
    terms = spark.read.parquet(f"{path}/terms")
    text = [f for f, _, kind in fields if kind == "text"]
    asked = queries.select("query", F.posexplode(tokens("query")).alias("pos", "qterm"))
    vocabulary = terms.filter(F.col("field").isin(text)).select("term").distinct()
    close = fuzzy_expansions(asked, vocabulary, fuzzy)
    close = close.withColumn("weight", 1.0 - F.col("dist") / F.least(F.length("qterm"), F.length("term")))
    near = asked.join(close.select("qterm", "term", "weight"), "qterm").select("query", "pos", "term", "weight")
    whole = queries.select("query", F.lit(0).alias("pos"), F.col("query").alias("term"), F.lit(1.0).alias("weight"))
    boost = F.create_map(*(x for f, b, _ in fields for x in (F.lit(f), F.lit(float(b)))))
    n, df = F.col("n"), F.col("df")
    own = terms.filter(F.col("field").isin([f for f, _, _ in fields])).join(F.broadcast(spark.read.parquet(f"{path}/fields")), "field")
    of_kind = own.filter(F.col("field").isin(text)).join(near, "term").unionByName(own.filter(~F.col("field").isin(text)).join(whole, "term"))
    return of_kind.select("query", "field", "pos", "term", _bucket_of("term", "buckets"),
                          (boost[F.col("field")] * F.col("weight") * F.log(1.0 + (n - df + 0.5) / (df + 0.5))).alias("w"))


def _bucket_of(term: str, buckets: str) -> Column:
    return F.pmod(F.xxhash64(term), F.col(buckets)).cast("int").alias("bucket")


def _scored(num: int):
    """Of the rows of one (query, block) its best documents: best term per position, summed by field, the best field counts."""
    def run(table: pa.Table) -> pa.Table:
        _, slot = np.unique(np.array([f"{f}\0{p}" for f, p in zip(table["field"].to_pylist(), table["pos"].to_pylist(), strict=True)]), return_inverse=True)
        names, field = np.unique(table["field"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        items, factors = table["items"].combine_chunks(), table["factors"].combine_chunks()
        size = pa.compute.list_value_length(items).to_numpy(zero_copy_only=False)
        coded = items.flatten().dictionary_encode()
        at, of = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)
        best = np.zeros((slot.max() + 1, len(coded.dictionary)))
        np.maximum.at(best, (slot[of], at), table["w"].to_numpy()[of] * factors.flatten().to_numpy())
        by_field = np.zeros((len(names), best.shape[1]))
        field_of = np.zeros(len(best), np.int64)
        field_of[slot] = field
        np.add.at(by_field, field_of, best)
        score = by_field.max(axis=0)
        tie = np.round(score, DIGITS)
        place = np.empty(len(tie), np.int64)
        place[pa.compute.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(tie))
        top = np.lexsort((place, -tie))[:num]
        top = top[score[top] > 0]
        return pa.table({"query": pa.array([table["query"][0].as_py()] * len(top), pa.string()), "item_id": coded.dictionary.take(pa.array(top)),
                         "score": pa.array(score[top]), "tie": pa.array(tie[top])})
    return run


def block_bounds(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """query, block, bound, first: the most that a document of the block can score, and its smallest id that is concerned."""
    tops = postings.select("field", "bucket", "term", "block", "top", F.col("items")[0].alias("first"))
    return (asked.join(tops, ["field", "bucket", "term"]).select("query", "block", "field", "pos", (F.col("w") * F.col("top")).alias("s"), "first")
            .repartition("query", "block")
            .groupBy("query", "block", "field", "pos").agg(F.max("s").alias("s"), F.min("first").alias("first"))
            .groupBy("query", "block", "field").agg(F.sum("s").alias("s"), F.min("first").alias("first"))
            .groupBy("query", "block").agg(F.max("s").alias("bound"), F.min("first").alias("first")))


def search_index(spark: SparkSession, path: str, queries: DataFrame, num: int, fields, fuzzy: bool = True,
                 report: dict | None = None) -> DataFrame:
    """(query, rank, item_id, score > 0) of distinct non-null queries; ``report`` receives the (query, block) pairs there were and were scored."""
    scratch = scratch_folder(spark, "search")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{scratch}/{name}")
        return spark.read.parquet(f"{scratch}/{name}")
    q = queries.select("query").filter(F.col("query").isNotNull()).distinct()
    asked = kept(_query_terms(spark, path, q, fields, fuzzy), "terms")
    # the postings of terms that some query asks for, read three times below
    postings = kept(_postings(spark, path).join(asked.select("field", "bucket", "term").distinct(), ["field", "bucket", "term"], "left_semi"), "postings")
    bounds = kept(block_bounds(postings, asked), "bounds")
    postings = postings.select("field", "bucket", "term", "block", "items", "factors")
    item_type = postings.schema["items"].dataType.elementType.simpleString()

    def scored(pairs: DataFrame) -> DataFrame:
        rows = pairs.select("query", "block").join(asked, "query").join(postings, ["field", "bucket", "term", "block"])
        return rows.groupBy("query", "block").applyInArrow(_scored(num), f"query string, item_id {item_type}, score double, tie double")
    in_order = [F.col("tie").desc(), F.col("item_id")]
    first = top_k_per_key(bounds, ["query"], [F.col("bound").desc(), F.col("first"), F.col("block")], SEED_BLOCKS).drop("rank")
    seeds = kept(first, "seeds")
    early = kept(top_k_per_key(scored(seeds), ["query"], in_order, num), "early")
    beat = early.filter(F.col("rank") == num).select("query", F.col("tie").alias("least"), F.col("item_id").alias("last"))
    # sums of bounds may differ from sums of scores in the last bits
    reach = F.round(F.col("bound") * (1 + 1e-12), DIGITS)
    rest = kept(bounds.join(seeds.select("query", "block"), ["query", "block"], "left_anti").join(beat, "query", "left")
                .filter(F.col("least").isNull() | (reach > F.col("least")) | (reach >= F.col("least")) & (F.col("first") <= F.col("last"))), "rest")
    if report is not None:
        report.update(pairs=bounds.count(), scored=seeds.count() + rest.count())
    both = early.drop("rank").unionByName(scored(rest))
    return top_k_per_key(both, ["query"], in_order, num).select("query", "rank", "item_id", "score")
