"""Distinct counts that can be merged: bitmaps of value numbers per key.

A value has one number in a dictionary that only grows, so bitmaps of different runs speak of the same values. A count
over any set of runs or groups is then an OR of bitmaps: the rows behind them are not read again, and the count is exact.
A bitmap is a word that covers 64 numbers; a key has a row per range of numbers that occurs in it, so keys with few values
stay as small as their rows, and words are combined where the rows are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import rank_within

DICTIONARY = "value string, number bigint"
WORD = 64


def extend(known: DataFrame | None, values: DataFrame, column: str) -> DataFrame:
    """``value, number`` of the values of ``column`` that ``known`` lacks, numbered on from its highest number.

    Numbers start at 1. NULL is no value, an empty string is one. Values are numbered in slices with offsets, never in one task.
    """
    fresh = values.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    if known is None:
        return rank_within(fresh, [], ["value"], "number").select("value", F.col("number").cast("bigint").alias("number"))
    fresh = fresh.join(known.select("value"), "value", "left_anti")
    highest = known.agg(F.coalesce(F.max("number"), F.lit(0)).alias("n")).first()["n"]
    ranked = rank_within(fresh, [], ["value"], "number")
    return ranked.select("value", (F.col("number") + F.lit(highest)).cast("bigint").alias("number"))


def bitmaps(rows: DataFrame, keys: Sequence[str], column: str, dictionary: DataFrame) -> DataFrame:
    """``keys, bucket, bits``: the numbers of the values of ``column`` per key.

    A key with a third of all rows is spread over the ranges of its values, each combined before rows are moved. A key
    whose values are all NULL has one row with NULL ``bucket`` and ``bits``. A value the dictionary lacks is an error, since
    leaving it out would give a count that is too small.
    """
    pairs = rows.select(*keys, F.col(column).cast("string").alias("value"))
    numbered = pairs.join(dictionary.select("value", "number"), "value", "left")
    unknown = F.raise_error(F.concat(F.lit("no number in the dictionary: "), F.col("value"))).cast("bigint")
    number = F.when(F.col("value").isNotNull() & F.col("number").isNull(), unknown).otherwise(F.col("number"))
    return _construct(numbered.withColumn("number", number), keys)


def _construct(numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    bit = F.expr(f"shiftleft(1L, cast(number % {WORD} AS int))")
    return numbered.groupBy(*keys, F.expr(f"number div {WORD}").alias("bucket")).agg(F.bit_or(bit).alias("bits"))


def merged(stored: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Bitmaps by coarser ``keys``, such as those of all runs or of a month."""
    return stored.groupBy(*keys, "bucket").agg(F.bit_or("bits").alias("bits"))


def counts(stored: DataFrame, keys: Sequence[str | Column], name: str) -> DataFrame:
    """Exact number of distinct values per key; zero for keys that have none."""
    joined = merged(stored, keys)
    kept = [c for c in joined.columns if c not in ("bucket", "bits")]
    number = F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))
    return joined.groupBy(*kept).agg(number.alias(name))
