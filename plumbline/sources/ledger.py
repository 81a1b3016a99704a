"""Reading and appending the run ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.schemas import LEDGER


def table_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}"


def read_ledger(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One ledger table with its fixed schema; empty before the first append."""
    table = LEDGER[name]
    schema = table.schema
    if table.day and table.day not in schema.fieldNames():
        schema = T.StructType([*schema.fields, T.StructField(table.day, T.DateType())])
    try:
        return spark.read.schema(schema).parquet(table_path(base, name))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def to_ledger(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the column order and types of a ledger table.

    Missing optional columns become NULL; a NULL in a required one stops the job.
    """
    columns = []
    for field in LEDGER[name].schema.fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = value.cast(field.dataType)
        if not field.nullable:
            message = F.lit(f"{name}.{field.name} is required")
            value = F.coalesce(value, F.raise_error(message).cast(field.dataType))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def append_ledger(df: DataFrame, base: str, name: str, max_rows_per_file: int = 5_000_000) -> None:
    """Append rows, day-partitioned and sorted by the cluster keys inside each file.

    Rows are brought together by day, so that a task writes few days; adaptive
    execution splits a large day over many tasks.
    """
    table = LEDGER[name]
    rows = to_ledger(df, name)
    if table.day and table.day_of:
        rows = rows.withColumn(table.day, F.to_date(table.day_of))
    if table.day:
        rows = rows.hint("rebalance", table.day)
    sort_keys = [*([table.day] if table.day else []), *table.cluster]
    if sort_keys:
        rows = rows.sortWithinPartitions(*sort_keys)
    writer = rows.write.mode("append").option("maxRecordsPerFile", max_rows_per_file)
    if table.day:
        writer = writer.partitionBy(table.day)
    writer.parquet(table_path(base, name))


def new_runs(runs: DataFrame, ledger: DataFrame, as_of: datetime) -> DataFrame:
    """Runs whose id the ledger has not recorded in the two days before ``as_of``.

    The bound on the partition column limits the scan to the newest days.
    """
    since = F.lit(as_of) - F.expr("INTERVAL 2 DAY")
    recent = ledger.where(F.col("execution_ts") >= since)
    day = LEDGER["executions"].day
    if day in ledger.columns:
        recent = recent.where(F.col(day) >= F.to_date(since))
    return runs.join(recent.select("execution_id"), "execution_id", "left_anti")


def record_run(
    spark: SparkSession, base: str, run: DataFrame, children: dict[str, DataFrame], as_of: datetime
) -> bool:
    """Write a run once: the child tables first and its execution record last.

    ``run`` holds the single execution record. Returns False, and writes
    nothing, when the ledger already has this id.
    """
    fresh = new_runs(run, read_ledger(spark, base, "executions"), as_of)
    if fresh.isEmpty():
        return False
    for name, rows in children.items():
        append_ledger(rows, base, name)
    append_ledger(run, base, "executions")
    return True


def run_path(prefix: str, execution_id: str, folder: str) -> str:
    return f"{prefix.rstrip('/')}/{execution_id}/{folder}"
