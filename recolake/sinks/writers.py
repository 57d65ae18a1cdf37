"""Sinks (K1-K5, K7, K9-K11): distributed writes, counts without a re-scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def overwrite_table(df: DataFrame, path: str, fmt: str = "parquet",
                    partition_by: list[str] | None = None, table: str | None = None) -> int:
    """K1/K3: overwrite and return the written row count. The count is an
    ``Observation`` on the write itself - no second pass over the data."""
    obs = Observation("written")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = observed.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if table:
        w.option("path", path).saveAsTable(table)
    else:
        w.save(path)
    return int(obs.get["rows"])


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """K2: append (batching is the writer's job)."""
    obs = Observation("appended")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("append").format(fmt).save(path)
    return int(obs.get["rows"])


def export_vectors_json(vectors: DataFrame, path: str, id_col: str = "item_id",
                        vec_col: str = "model_factor") -> None:
    """K4: ``(id, features)`` as JSON lines, written by the executors."""
    vectors.select(F.col(id_col).alias("asin"), F.col(vec_col).alias("features")).write.mode(
        "overwrite").json(path)


def export_dimension(dim: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K5: label -> index map."""
    dim.write.mode("overwrite").format(fmt).save(path)


def write_vector_index(vectors: DataFrame, path: str, buckets: int = 64,
                       id_col: str = "item_id") -> None:
    """K7: recreate the vector table, partitioned by an id hash bucket so a
    lookup by id prunes to one directory."""
    (vectors.withColumn("bucket", F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)))
     .repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path))


def write_metrics(spark, metrics: dict, path: str) -> None:
    """K9: one-row metrics document."""
    spark.createDataFrame([metrics]).coalesce(1).write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    """Persist a model/pipeline, overwriting."""
    model.write().overwrite().save(path)


def write_first_labels(dim: DataFrame, path: str, k: int = 1000, label_col: str | None = None) -> None:
    """The first k labels by index as text lines."""
    label_col = label_col or dim.columns[0]
    (dim.filter(F.col("idx") < k).orderBy("idx").select(F.col(label_col).cast("string"))
     .write.mode("overwrite").text(path))


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int,
                   sort: bool = True, path: str | None = None) -> None:
    """Persist a fact bucketed (and sorted) by its join/group keys, e.g. the
    interactions by ``user_id``: later joins and per-key aggregations between
    tables bucketed the same way read co-located buckets without a shuffle."""
    w = df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys)
    if sort:
        w = w.sortBy(*keys)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
