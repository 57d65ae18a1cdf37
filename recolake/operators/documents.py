"""Search documents: product + latest vector, keyed upsert (J1, K6, F12, P9,
P11, P14, P15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed2


def latest_vectors(vectors: DataFrame, key: str = "item_id", order: str | None = "model_timestamp") -> DataFrame:
    """W7/J1 right side: one vector per key, the latest by ``order`` (a partial
    ``max_by`` aggregate; a hot key is combined map-side)."""
    if order is None or order not in vectors.columns:
        return vectors.groupBy(key).agg(F.first("model_factor").alias("model_factor"))
    return vectors.groupBy(key).agg(F.max_by("model_factor", order).alias("model_factor"))


def image_urls(images: Column) -> Column:
    """per image the ``large`` URL, else ``thumb``; images with neither are skipped."""
    return F.filter(F.transform(images, lambda i: F.coalesce(i["large"], i["thumb"])),
                    lambda u: u.isNotNull())


def product_documents(products: DataFrame, vectors: DataFrame, key: str = "item_id",
                      parent_key: str | None = None) -> DataFrame:
    """Product LEFT JOIN latest vector on the document key; products
    without a vector are kept. With ``parent_key`` the document id is the parent
    id when present and non-blank (Python truthiness), else the product id."""
    v = latest_vectors(vectors, key)
    doc_id = F.col(key)
    if parent_key:
        p = F.col(parent_key)
        doc_id = F.when(p.isNotNull() & (F.trim(p.cast("string")) != ""), p).otherwise(F.col(key))
    out = products.join(v, key, "left").withColumn("doc_id", doc_id)
    if "images" in products.columns and dict(products.dtypes)["images"].startswith("array<struct"):
        out = out.withColumn("images", image_urls(F.col("images")))
    return out.drop("_id") if "_id" in out.columns else out


def upsert(existing: DataFrame, updates: DataFrame, key: str = "doc_id",
           seq: str | None = None) -> DataFrame:
    """K6: keyed upsert. Within ``updates`` the last write per key wins: the highest ``seq``; without one, or where it ties, the row that is
    largest by its columns in turn, so that a rerun keeps the same. The result is the updates plus every existing row whose key was
    not updated (anti join) - a MERGE expressed as union + anti join. A standing table is merged bucket by bucket: ``document_store``."""
    order = ([F.col(seq)] if seq is not None else []) + [F.to_json(F.struct(*updates.columns))]
    last = updates.groupBy(key).agg(F.max_by(F.struct(*updates.columns), F.struct(*order)).alias("_r"))
    updates = last.select("_r.*")
    kept = existing.join(updates.select(key), key, "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def display_projection(items: DataFrame) -> DataFrame:
    """What list pages show: 50-char title, integer stars, first image."""
    cols = [F.col("item_id"), F.substring("title", 1, 50).alias("short_title"),
            F.floor("average_rating").cast("bigint").alias("stars")]
    if "images" in items.columns:
        cols.append(F.try_element_at("images", F.lit(1)).alias("first_image"))
    return items.select(*cols)


def product_page(items: DataFrame) -> DataFrame:
    """What product and result pages show: 60-char title, 150-char text, the first three descriptions and five features, the score
    (``score`` or the mean rating) with two decimals. Columns that the items lack are left out."""
    cols = [F.col("item_id"), F.substring("title", 1, 60).alias("short_title")]
    kinds = dict(items.dtypes)
    if "description" in kinds:
        text = F.array_join("description", " ") if kinds["description"].startswith("array") else F.col("description")
        cols.append(F.substring(text, 1, 150).alias("short_text"))
    for name, most in (("descriptions", 3), ("features", 5)):
        if name in kinds:
            cols.append(F.slice(name, 1, most).alias(name))
    score = "score" if "score" in kinds else "average_rating"
    if score in kinds:
        cols.append(fixed2(score).alias("score"))
    return items.select(*cols)
