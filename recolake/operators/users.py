"""User registration as a table job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import username as username_expr
from .encode import row_positions


def insert_users(batch: DataFrame, existing: DataFrame, order: list[Column],
                 created_at: Column | None = None, domain: str = "example.com") -> DataFrame:
    """Insert-if-absent for a batch of user ids in input order.

    Every batch row gets its 0-based input position (W9); a row is inserted
    when its id is not in ``existing`` and no earlier row of the batch has
    the same id (the reference probes the store row by row, so the first
    occurrence wins). The username uses the position: ``user_%03d_<id[:8]>``.
    Returns the batch with ``position``, ``inserted``, ``username``, ``email``.
    """
    pos = row_positions(batch, order, "position")
    first = pos.groupBy("user_id").agg(F.min("position").alias("_first"))
    known = existing.select("user_id").distinct().withColumn("_exists", F.lit(True))
    flagged = (pos.join(first, "user_id").join(known, "user_id", "left")
               .withColumn("inserted", F.col("_exists").isNull() & (F.col("position") == F.col("_first"))))
    name = username_expr("position", "user_id")
    ts = created_at if created_at is not None else F.current_timestamp()
    return flagged.select(
        "user_id", "position", "inserted",
        F.when(F.col("inserted"), name).alias("username"),
        F.when(F.col("inserted"), F.concat(name, F.lit("@" + domain))).alias("email"),
        F.when(F.col("inserted"), ts).alias("created_at"))


def insert_counts(result: DataFrame) -> DataFrame:
    return result.agg(F.count_if("inserted").alias("inserted"),
                      F.count_if(~F.col("inserted")).alias("skipped"))


def newest_users(users: DataFrame, n: int = 5) -> DataFrame:
    """Newest n users by creation time (ties by id)."""
    return users.orderBy(F.col("created_at").desc(), F.col("user_id")).limit(n)


def clean_id_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Trimmed, non-blank id lines."""
    return lines.select(F.trim(F.col(col)).alias("user_id")).filter(F.col("user_id") != "")
