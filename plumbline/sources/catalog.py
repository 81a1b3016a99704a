"""Catalog metadata as one inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.labels import norm_type

KEYS = ["project", "dataset", "object_name"]


def catalog_union(tables: DataFrame, routines: DataFrame) -> DataFrame:
    """Objects of a catalog: tables and views, then routines, with normalised types."""

    def objects(df: DataFrame, missing: str) -> DataFrame:
        kind = norm_type(F.coalesce("object_type", F.lit(missing)))
        return df.select(*KEYS, kind.alias("object_type"))

    return objects(tables, "unknown").unionByName(objects(routines, "routine"))


def catalog_inventory(tables: DataFrame, columns: DataFrame, views: DataFrame, routines: DataFrame) -> DataFrame:
    """One row per catalog object from the four metadata tables.

    The inputs are united and grouped once instead of joined four times. An
    object known only by columns has type ``unknown``, one known only by a view
    definition ``view``; a routine replaces everything else of that name.
    Columns stay in their own table, only their number is kept here.
    """
    empty = {"object_type": None, "ddl": None, "view_query": None, "definition_body": None}

    def tagged(df: DataFrame, kind: str, **given) -> DataFrame:
        values = {**empty, **given}
        return df.select(
            *KEYS,
            F.lit(kind).alias("kind"),
            *[(F.lit(None) if v is None else v).cast("string").alias(k) for k, v in values.items()],
        )

    rows = reduce(
        DataFrame.unionByName,
        [
            tagged(tables, "table", object_type=norm_type(F.col("object_type")), ddl=F.col("ddl")),
            tagged(columns, "column"),
            tagged(views, "view", view_query=F.col("view_definition")),
            tagged(
                routines,
                "routine",
                object_type=norm_type(F.col("object_type")),
                definition_body=F.col("routine_definition"),
            ),
        ],
    )

    def of(kind: str, column: str):
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    def has(kind: str):
        return F.count_if(F.col("kind") == kind)

    grouped = rows.groupBy(*KEYS).agg(
        of("table", "object_type").alias("table_type"),
        of("table", "ddl").alias("table_ddl"),
        of("view", "view_query").alias("view_text"),
        of("routine", "object_type").alias("routine_type"),
        of("routine", "definition_body").alias("body"),
        has("table").alias("tables"),
        has("column").alias("column_rows"),
        has("routine").alias("routines"),
    )
    routine = F.col("routines") > 0
    kind = (
        F.when(routine, F.coalesce("routine_type", F.lit("routine")))
        .when(F.col("tables") > 0, F.coalesce("table_type", F.lit("unknown")))
        .when(F.col("column_rows") > 0, F.lit("unknown"))
        .otherwise(F.lit("view"))
    )
    return grouped.select(
        *KEYS,
        kind.alias("object_type"),
        F.when(~routine, F.col("table_ddl")).alias("ddl"),
        F.when(~routine, F.col("view_text")).alias("view_query"),
        F.when(routine, F.col("body")).alias("definition_body"),
        F.when(routine, F.lit(0)).otherwise(F.col("column_rows")).cast("bigint").alias("column_count"),
    )
