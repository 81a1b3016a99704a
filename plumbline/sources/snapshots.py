"""Stored report snapshots, bucketed by key, that are compared without moving their rows.

Both snapshots lie in buckets of the same hash of the key, so the comparison joins bucket with bucket. The one shuffle of
a snapshot is paid when it is stored, however often it is compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "snapshot_key"


def store_snapshot(report: DataFrame, name: str, path: str, keys: Sequence[str], order: str, buckets: int) -> None:
    """Write a report as table ``name`` below ``path``; the last of repeated rows (by ``order``) stands for a key.

    ``order`` is not kept. Snapshots are comparable when they have the same keys and ``buckets``. Choose ``buckets`` so that
    one holds some hundred MB. NULL in a key is a value of its own, apart from an empty string.
    """
    payload = [c for c in report.columns if c not in (*keys, order)]
    if KEY in report.columns:
        raise ValueError(f"column {KEY} is reserved")
    row = F.struct(*[F.col(c) for c in payload], F.lit(1).alias("_present"))
    last = report.groupBy(*keys).agg(F.max_by(row, order).alias("_row"))
    flat = last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])
    keyed = flat.withColumn(KEY, F.to_json(F.struct(*keys)))  # leaves NULL out, so one text is one key
    placed = keyed.repartition(buckets, KEY)  # the hash of the buckets: one file each
    placed.write.mode("errorifexists").bucketBy(buckets, KEY).sortBy(KEY).option("path", path).saveAsTable(name)


def compare_snapshots(spark: SparkSession, old: str, new: str) -> DataFrame:
    """Rows of one snapshot only, with ``side``, as ``reconcile.report_diff`` gives them for the reports."""
    before, after = spark.table(old), spark.table(new)
    columns = [c for c in before.columns if c != KEY]
    if sorted(before.columns) != sorted(after.columns):
        raise ValueError("the snapshots have other columns")
    joined = before.alias("o").join(after.alias("n"), F.col(f"o.{KEY}") == F.col(f"n.{KEY}"), "full_outer")
    alone = joined.where(F.col(f"o.{KEY}").isNull() | F.col(f"n.{KEY}").isNull())
    in_old = F.col(f"n.{KEY}").isNull()
    side = F.when(in_old, F.lit("only_in_old")).otherwise(F.lit("only_in_new"))
    return alone.select(side.alias("side"), *[F.when(in_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in columns])
