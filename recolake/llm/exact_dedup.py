"""Exact deduplication over a persistent digest index (DataFrame operations only).

The index is a table of SHA-256 digests, bucketed and sorted by digest. New rows are
deduplicated by a sort-merge anti join against it (the index side is read bucket by bucket
without a shuffle) and the new digests are appended. Only digests and ids move; texts never do.

Defined results: a null text counts as empty; equal texts (no normalisation) form one group;
of a group the row with the largest doc_id stays, and rows repeating that doc_id stay with it;
null ids count as the smallest, and stay only in a group of null ids alone. An empty table
gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, stored

# a group above this share of all rows is attached by broadcast: there can be at most as many as its inverse
HOT_SHARE = 1000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest: SHA-256 of the text in UTF-8, as 64 lowercase hex digits."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256).alias("digest"))


class DigestIndex:
    """Persistent digest index at ``path``: digest, keep_id, group_size, bucketed and sorted by digest.

    A later session opens it again by the same path and bucket count."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"""CREATE TABLE {self.table} (digest STRING, keep_id BIGINT, group_size BIGINT) USING parquet
                      CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'""")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, rows: DataFrame) -> None:
        """Append the groups of a batch (doc_id, digest) whose digests the index lacks.

        Grouping combines on the map side, so a group of any size is one row per map task."""
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        new = groups.join(self.read().hint("merge"), "digest", "left_anti")
        (new.repartition(self.buckets, "digest").write.mode("append").format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table))


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's decision against the index, after its own digests are added.

    doc_id, keep_id (the id that stays), group_size, kept, text_sha256. Rows whose digest an
    earlier batch brought in get that batch's keep_id and are not kept."""
    rows = stored(digests(docs, id_col, text_col), "digests")
    index.add(rows)
    n = rows.count()
    known = index.read()
    # at most HOT_SHARE groups can be this large, so their broadcast is bounded; all others are joined by merging
    hot = (known.filter(F.col("group_size") * HOT_SHARE > max(n, HOT_SHARE))
           .orderBy(F.desc("group_size"), "digest").limit(HOT_SHARE))
    hot_groups = hot.select("digest", F.struct("keep_id", "group_size").alias("hot"))
    split = rows.join(F.broadcast(hot_groups), "digest", "left")
    large = split.filter("hot is not null").select("doc_id", "digest", "hot.keep_id", "hot.group_size")
    small = (split.filter("hot is null").select("doc_id", "digest")
             .join(known.hint("merge"), "digest").select("doc_id", "digest", "keep_id", "group_size"))
    return large.unionByName(small).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, index_path: str | None = None, buckets: int | None = None) -> DataFrame:
    """``deduplicate`` over a new index (in the shared folder unless a path is given)."""
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return deduplicate(docs, DigestIndex(spark, index_path or scratch_path(spark, "digest-index"), buckets))
