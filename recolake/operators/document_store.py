"""A standing table of documents, merged by key and sequence number.

The snapshot is a folder per bucket of the key's hash and, in it, a folder per generation; the last complete generation of a bucket holds. A merge
keeps of every key the write of the highest sequence number, stored or new, and writes a new generation of the buckets that the batch touches; the
others stay as they are. A deletion is a write too: it stays as a tombstone, so an older write that comes late does not bring
the document back.

Defined results: rows without a key or sequence number are no writes (P9); equal sequence numbers of a key are decided by the row's
content, so replaying a batch changes nothing; an empty batch writes nothing; columns that only one side has are null on the other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DocumentStore:
    path: str
    buckets: int = 64
    key: str = "doc_id"
    seq: str = "seq"
    deleted: str = "deleted"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _last(self, spark: SparkSession) -> dict[int, int]:
        """The last complete generation of each bucket, from the log of merges: a row per bucket written."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return {}
        log = spark.read.schema("bucket int, generation int").parquet(f"{self.path}/log")
        return {r.bucket: r.g for r in log.groupBy("bucket").agg(F.max("generation").alias("g")).collect()}

    def _read(self, spark: SparkSession, last: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/generation={g}/bucket={b}" for b, g in sorted(last.items())]
        return spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def merge(self, writes: DataFrame) -> list[int]:
        """Merge a batch of writes; returns the buckets that were rewritten. A merge that fails before its log entry has not happened."""
        spark = writes.sparkSession
        if self.deleted not in writes.columns:
            writes = writes.withColumn(self.deleted, F.lit(False))
        writes = writes.filter(F.col(self.key).isNotNull() & F.col(self.seq).isNotNull())
        writes = writes.withColumn(self.deleted, F.coalesce(self.deleted, F.lit(False)))
        # at most one number a bucket
        touched = sorted(r[0] for r in writes.select(self._bucket()).distinct().collect())
        if not touched:
            return []
        last = self._last(spark)
        old = self._read(spark, {b: g for b, g in last.items() if b in set(touched)})
        rows = writes if old is None else old.unionByName(writes, allowMissingColumns=True)
        newest = F.struct(F.col(self.seq), F.to_json(F.struct(*sorted(rows.columns))))
        merged = rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), newest).alias("r")).select("r.*")
        generation = max(last.values(), default=0) + 1
        (merged.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.path}/data/generation={generation}"))
        (spark.createDataFrame([(b, generation) for b in touched], "bucket int, generation int").coalesce(1)
         .write.mode("append").parquet(f"{self.path}/log"))
        return touched

    def read(self, spark: SparkSession, tombstones: bool = False) -> DataFrame | None:
        """The documents that are there; None before the first merge."""
        rows = self._read(spark, self._last(spark))
        if rows is None or tombstones:
            return rows
        return rows.filter(~F.col(self.deleted)).drop(self.deleted)
