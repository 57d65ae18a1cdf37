"""End-to-end jobs (M12, M13, search-document build): the reference's
``make data / train / index`` as Spark jobs that keep data distributed."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cf, documents, encode, ratings, search, search_index
from ..sinks import writers
from ..sources import files


def process_all(spark: SparkSession, review_path: str, meta_path: str, out_dir: str,
                compat: bool = False) -> dict:
    """Scan reviews and products, save both, prepare and encode ratings,
    persist the dims and the encoded table. Returns row counts (observed on
    the writes, no extra scans)."""
    reviews = files.load_reviews(spark, review_path)
    products = files.load_products(spark, meta_path)
    counts = {
        "reviews": writers.overwrite_table(reviews, os.path.join(out_dir, "reviews")),
        "products": writers.overwrite_table(products, os.path.join(out_dir, "products")),
    }
    saved = spark.read.parquet(os.path.join(out_dir, "reviews"))
    r = ratings.prepare_ratings_first(
        saved.select("user_id", F.col("asin").alias("item_id"), "rating",
                     F.timestamp_millis("timestamp").alias("ts")), compat=compat)
    # written once: both dimensions and the encoded table read the de-duplicated ratings
    writers.overwrite_table(r, os.path.join(out_dir, "ratings_prepared"))
    r = spark.read.parquet(os.path.join(out_dir, "ratings_prepared"))
    udim = encode.dense_index(r.select("user_id"), "user_id")
    idim = encode.dense_index(r.select("item_id"), "item_id")
    counts["user_dim"] = writers.overwrite_table(udim, os.path.join(out_dir, "user_dim"))
    counts["item_dim"] = writers.overwrite_table(idim, os.path.join(out_dir, "item_dim"))
    udim = spark.read.parquet(os.path.join(out_dir, "user_dim"))
    idim = spark.read.parquet(os.path.join(out_dir, "item_dim"))
    enc = encode.encode_ratings(r, udim, idim)
    counts["ratings_encoded"] = writers.overwrite_table(enc, os.path.join(out_dir, "ratings_encoded"))
    return counts


def train_and_save(spark: SparkSession, data_dir: str, model_dir: str, max_iter: int = 10,
                   reg_param: float = 0.01, rank: int = 25, version: str = "v1") -> dict:
    """Hash split, ALS fit, evaluate, export item vectors, save model and
    metrics. The training split is written first (a lineage cut that survives
    executor loss) instead of being cached in executor memory only."""
    enc = spark.read.parquet(os.path.join(data_dir, "ratings_encoded"))
    train, test = ratings.hash_split(enc, ["user_id", "item_id"])
    train_path = os.path.join(model_dir, "train_split")
    writers.overwrite_table(train.select(F.col("user_idx").cast("int"), F.col("item_idx").cast("int"),
                                         "rating"), train_path)
    model = cf.fit_als(spark.read.parquet(train_path), rank=rank, max_iter=max_iter, reg_param=reg_param)
    pred = model.transform(test.select(F.col("user_idx").cast("int"), F.col("item_idx").cast("int"), "rating"))
    m = cf.regression_metrics(pred.na.drop()).first()
    writers.save_model(model, os.path.join(model_dir, "als_model"))
    idim = spark.read.parquet(os.path.join(data_dir, "item_dim"))
    vectors = cf.item_factor_table(model, idim, version)
    n_vec = writers.overwrite_table(vectors, os.path.join(model_dir, "item_vectors"))
    metrics = {"rmse": float(m["rmse"] or 0.0), "mae": float(m["mae"] or 0.0), "model_version": version,
               "rank": rank, "max_iter": max_iter, "reg_param": reg_param}
    writers.write_metrics(spark, metrics, os.path.join(model_dir, "metrics"))
    return {**metrics, "item_vectors": n_vec}


def build_search_docs(spark: SparkSession, data_dir: str, model_dir: str, out_path: str,
                      previous_path: str | None = None) -> int:
    """Search index build (J1, P9, F12, K6): products LEFT JOIN the latest vector
    of their parent id (vectors are keyed by review item id, trap 3), document
    id = parent id; merged over a previous build when given (keyed upsert)."""
    products = spark.read.parquet(os.path.join(data_dir, "products"))
    vectors = spark.read.parquet(os.path.join(model_dir, "item_vectors"))
    prod = products.filter(F.col("parent_asin").isNotNull() & (F.trim("parent_asin") != "")) \
        .withColumn("item_id", F.col("parent_asin"))
    docs = documents.product_documents(prod, vectors, key="item_id")
    if previous_path:
        docs = documents.upsert(spark.read.parquet(previous_path), docs, "doc_id")
    return writers.overwrite_table(docs, out_path)


def build_search_index(spark: SparkSession, docs_path: str, index_path: str) -> str:
    """The stored index over a search-document table, with the fields of both searches."""
    docs = spark.read.parquet(docs_path).withColumnRenamed("doc_id", "item_id")
    return search_index.build_index(docs, index_path, search.SEARCH_AND_RECOMMEND_FIELDS)


def search_job(spark: SparkSession, index_path: str, queries: DataFrame, num: int = 10, fuzzy: bool = True) -> DataFrame:
    """T1 (fuzzy) or T2 over a stored index for a table of queries."""
    fields = search.SEARCH_AND_RECOMMEND_FIELDS if fuzzy else search.SEARCH_PRODUCTS_FIELDS
    return search_index.search_index(spark, index_path, queries, num, fields, fuzzy)


def recommend_job(spark: SparkSession, users: DataFrame, data_dir: str, model_dir: str,
                  num: int = 10, *, fallback_category: str) -> DataFrame:
    """R6 over a table of users with the trained model's factors; ``fallback_category``
    fills half the list of a known user without a factor."""
    from ..operators import hybrid
    model, _ = files.load_models(os.path.join(model_dir, "als_model"))
    udim = files.load_table(spark, os.path.join(data_dir, "user_dim"))
    idim = files.load_table(spark, os.path.join(data_dir, "item_dim"))
    uf, itf = cf.factors_from_model(model, udim, idim)
    items = spark.read.parquet(os.path.join(data_dir, "products")).select(
        F.col("parent_asin").alias("item_id"), "title", "main_category", "average_rating", "rating_number")
    items = items.dropDuplicates(["item_id"])
    return hybrid.hybrid_recommendations(users, udim, uf, itf, items, num, fallback_category=fallback_category)
