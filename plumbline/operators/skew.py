"""Helpers that keep very large groups off a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.session import cut_lineage


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Exact 1-based rank inside each key (or over all rows), without one task per key.

    Rows are range-partitioned by key and order, ranked inside (key, range
    partition), and shifted by the row counts of earlier partitions. The offset
    table has one row per key and partition it spans, so its windows stay small.
    ``order`` must be unique inside a key.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
    # Materialised, because a second evaluation may draw other range bounds.
    ranged = cut_lineage(ranged)
    inside = W.partitionBy(*keys, "_slice")
    local = ranged.withColumn("_local", F.row_number().over(inside.orderBy(*order)))
    sizes = ranged.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    if not keys:
        offsets = F.broadcast(offsets)  # one row per range partition
        joined = local.join(offsets, "_slice")
    else:
        condition = [local["_slice"] == offsets["_slice"]] + [local[k].eqNullSafe(offsets[k]) for k in keys]
        joined = local.join(offsets, condition).select(local["*"], offsets["_offset"])
    return joined.withColumn(name, F.col("_offset") + F.col("_local")).drop("_slice", "_local", "_offset")


def fill_forward(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, block: int = 65_536
) -> DataFrame:
    """Last non-NULL ``value`` at or before each row of its key, in ``order``.

    ``order`` is a row number. Rows are filled inside blocks of ``block`` row
    numbers; the value carried into a block comes from a table with one row per
    block, so a key as large as the whole input is still many tasks.
    """
    blocked = df.withColumn("_value", value).withColumn("_block", F.floor(F.col(order) / block))
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    filled = blocked.withColumn("_filled", F.last("_value", ignorenulls=True).over(inside))
    ends = blocked.groupBy(*keys, "_block").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end")
    )
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        *keys, "_block", F.last("_end", ignorenulls=True).over(before).alias("_carried")
    ).where(F.col("_carried").isNotNull())
    joined = filled.join(carried, [*keys, "_block"], "left")
    return joined.withColumn(name, F.coalesce("_filled", "_carried")).drop("_value", "_block", "_filled", "_carried")
