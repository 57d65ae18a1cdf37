"""Label indexing.

``StringIndexer`` collects every label into the driver and ships the label
array to every task; fine for thousands of labels, not for a billion users.
``dense_index`` builds the same index (frequency desc, label asc, 0-based) as
a distributed table:

1. ``groupBy(label).count()`` (partial aggregation)
2. global sort (range partitioned) and a reliable checkpoint, so the order is
   fixed for the two passes below
3. ``monotonically_increasing_id`` = (partition id << 33) + position: the
   per-partition row counts (one row per partition) give prefix offsets
4. idx = offset(partition) + position. The offsets table has one row per
   partition - a size bound that does not grow with the data - so it is
   broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POS_MASK = (1 << 33) - 1


def row_positions(df: DataFrame, order: list, pos_col: str = "position",
                  checkpoint: bool = True) -> DataFrame:
    """0-based position of every row in a global order (``order`` must be total),
    without a single-partition window: sort, checkpoint, then partition offsets."""
    ordered = df.orderBy(*order)
    if checkpoint:
        ordered = ordered.checkpoint(eager=True)
    mid = F.monotonically_increasing_id()
    tagged = ordered.select("*", F.shiftright(mid, 33).alias("_pid"),
                            mid.bitwiseAND(F.lit(_POS_MASK)).alias("_pos"))
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_size"))
    # one row per partition: a single-partition window over it is bounded
    offsets = sizes.select(
        "_pid", (F.sum("_size").over(Window.orderBy("_pid")) - F.col("_size")).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(pos_col, F.col("_off") + F.col("_pos")).drop("_pid", "_pos", "_off"))


def prefix_sum(df: DataFrame, order: list, value_col: str, out_col: str = "cum") -> DataFrame:
    """Inclusive running sum of ``value_col`` in a global order, computed in
    parallel: range-partitioned sort (a hot key's rows are split across
    partitions by the later sort columns), reliable checkpoint, per-partition
    local cumulative sums (Arrow batches), then per-partition offsets - one row
    per partition, the only broadcast."""
    import numpy as np

    ordered = df.orderBy(*order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    schema = T.StructType(list(ordered.schema.fields) + [T.StructField(out_col, T.DoubleType())])

    def local(batches):
        run = 0.0
        for pdf in batches:
            c = np.cumsum(pdf[value_col].fillna(0).to_numpy(dtype=np.float64)) + run
            if len(c):
                run = float(c[-1])
            yield pdf.assign(**{out_col: c})

    loc = ordered.mapInPandas(local, schema)
    totals = ordered.groupBy("_pid").agg(F.sum(value_col).cast("double").alias("_t"))
    offsets = totals.select("_pid", (F.coalesce(F.sum("_t").over(Window.orderBy("_pid")), F.lit(0.0))
                                     - F.coalesce(F.col("_t"), F.lit(0.0))).alias("_off"))
    return (loc.join(F.broadcast(offsets), "_pid")
            .withColumn(out_col, F.col(out_col) + F.col("_off")).drop("_pid", "_off"))


def dense_index(values: DataFrame, label_col: str, idx_col: str = "idx",
                count_col: str = "n", checkpoint: bool = True, weight_col: str | None = None) -> DataFrame:
    """(label, n, idx): idx 0.. by frequency desc, then label asc (StringIndexer order). ``weight_col``: rows stand for so many."""
    n = F.count(F.lit(1)) if weight_col is None else F.sum(weight_col)
    counts = values.filter(F.col(label_col).isNotNull()).groupBy(label_col).agg(n.alias(count_col))
    return row_positions(counts, [F.desc(count_col), F.col(label_col)], idx_col, checkpoint)


def encode_ratings(ratings: DataFrame, user_dim: DataFrame, item_dim: DataFrame,
                   user_col: str = "user_id", item_col: str = "item_id",
                   keep_invalid: bool = False) -> DataFrame:
    """M3: attach user_idx / item_idx from the dims.

    Two equi joins; Catalyst/AQE decide broadcast or sort-merge from the
    dims' runtime size. ``keep_invalid`` mirrors ``handleInvalid='keep'``:
    labels missing from a dim (and nulls) get index = dim size.
    """
    how = "left" if keep_invalid else "inner"
    u = user_dim.select(F.col(user_dim.columns[0]).alias(user_col), F.col("idx").alias("user_idx"))
    i = item_dim.select(F.col(item_dim.columns[0]).alias(item_col), F.col("idx").alias("item_idx"))
    out = ratings.join(u, user_col, how).join(i, item_col, how)
    if keep_invalid:
        nu = user_dim.agg(F.count(F.lit(1))).scalar()
        ni = item_dim.agg(F.count(F.lit(1))).scalar()
        out = (out.withColumn("user_idx", F.coalesce("user_idx", nu))
               .withColumn("item_idx", F.coalesce("item_idx", ni)))
    return out


def labels_to_items(indexed: DataFrame, dim: DataFrame, idx_col: str, label_col: str,
                    how: str = "inner") -> DataFrame:
    """Index -> label through the dim; out-of-dictionary indices have no
    dim row, so the inner join drops them."""
    d = dim.select(F.col("idx").alias(idx_col), F.col(dim.columns[0]).alias(label_col))
    return indexed.join(d, idx_col, how)


def first_labels(dim: DataFrame, k: int) -> DataFrame:
    """The first k labels by index (a filter on idx, no sort of the dim)."""
    return dim.filter(F.col("idx") < k)
