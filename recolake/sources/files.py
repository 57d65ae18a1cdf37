"""File sources with the reference's fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Review JSON lines (all nullable); image objects land as raw JSON text
REVIEW_SCHEMA = T.StructType([
    T.StructField("rating", T.DoubleType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("images", T.ArrayType(T.StringType())),
    T.StructField("asin", T.StringType()),
    T.StructField("parent_asin", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("helpful_vote", T.LongType()),
    T.StructField("verified_purchase", T.BooleanType()),
])

_IMAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("thumb", "large", "variant", "hi_res")])

# Product metadata JSON lines; ``details`` / ``bought_together`` kept as raw JSON text
PRODUCT_SCHEMA = T.StructType([
    T.StructField("main_category", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("average_rating", T.DoubleType()),
    T.StructField("rating_number", T.LongType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("description", T.ArrayType(T.StringType())),
    T.StructField("price", T.StringType()),
    T.StructField("images", T.ArrayType(_IMAGE)),
    T.StructField("store", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("details", T.StringType()),
    T.StructField("parent_asin", T.StringType()),
    T.StructField("bought_together", T.StringType()),
])

METRICS_SCHEMA = T.StructType([
    T.StructField("rmse", T.DoubleType()), T.StructField("mae", T.DoubleType()),
    T.StructField("model_version", T.StringType()), T.StructField("rank", T.IntegerType()),
    T.StructField("max_iter", T.IntegerType()), T.StructField("reg_param", T.DoubleType()),
])


def load_reviews(spark: SparkSession, path: str) -> DataFrame:
    """S1 (+S10): PERMISSIVE JSON scan; a bad line becomes an all-null row, a
    wrong-typed field becomes null. A missing path raises PATH_NOT_FOUND."""
    return spark.read.schema(REVIEW_SCHEMA).option("mode", "PERMISSIVE").json(path)


def load_products(spark: SparkSession, path: str) -> DataFrame:
    """Product metadata with the nested image structs."""
    return spark.read.schema(PRODUCT_SCHEMA).option("mode", "PERMISSIVE").json(path)


def load_raw_json(spark: SparkSession, path: str) -> DataFrame:
    """S3: raw JSON documents with an inferred schema (one sampling pass)."""
    return spark.read.json(path)


def load_table(spark: SparkSession, name_or_path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A catalog table, or a path in any format (connector options pass through)."""
    if fmt == "table":
        return spark.table(name_or_path)
    return spark.read.format(fmt).options(**options).load(name_or_path)


def load_id_lines(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """Ids one per line, trimmed, blanks dropped, in file order with a
    0-based ``position``; ``k`` keeps the first k (the reference's head of file).
    Order comes from the file split order plus the in-split line order, via
    partition offsets (no single-partition window)."""
    from ..operators.encode import row_positions
    raw = spark.read.text(path).select(
        F.col("value"), F.input_file_name().alias("_f"),
        F.monotonically_increasing_id().alias("_mid"))
    lines = raw.select(F.trim("value").alias("user_id"), "_f", "_mid").filter(F.col("user_id") != "")
    pos = row_positions(lines, [F.col("_f"), F.col("_mid")], "position").drop("_f", "_mid")
    return pos.filter(F.col("position") < k) if k is not None else pos


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics document (one JSON object, possibly pretty-printed)."""
    return spark.read.schema(METRICS_SCHEMA).option("multiLine", True).json(path)


def load_models(path_model: str, path_indexer: str | None = None):
    """Persisted ALS model and (optional) label-indexer pipeline."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.recommendation import ALSModel
    model = ALSModel.load(path_model)
    indexer = PipelineModel.load(path_indexer) if path_indexer else None
    return model, indexer
