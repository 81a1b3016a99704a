"""Runs that appear as a whole or not at all, and reads that open the files of one run only.

Rows of a run lie below ``<table>/attempt=<id>/run=<execution id>``. The run log is written last, as one file: it names
the attempt whose rows count, so readers see all tables of a run or none, and rows of an attempt that was ended stay
unseen. A run is found by its id, whatever the dates in its rows say.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from plumbline.operators.runs import latest_run
from plumbline.sources.ledger import table_path, to_ledger
from plumbline.sources.schemas import LEDGER

LOG = "executions"
_PLACE = [T.StructField("attempt", T.StringType()), T.StructField("run", T.StringType())]


def _read(spark: SparkSession, base: str, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).option("basePath", base).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def published_runs(spark: SparkSession, base: str) -> DataFrame:
    """The run log with the ``attempt`` that counts for each run; of two that were published at once, one."""
    path = table_path(base, LOG)
    rows = _read(spark, path, path, T.StructType([*LEDGER[LOG].schema.fields, _PLACE[0]]))
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy("execution_id").orderBy("attempt")))
    return ranked.where("_rank = 1").drop("_rank")


def read_published(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Rows of a table of all published runs."""
    runs = published_runs(spark, base)
    if name == LOG:
        return runs.drop("attempt")
    path = table_path(base, name)
    rows = _read(spark, path, path, T.StructType([*LEDGER[name].schema.fields, *_PLACE]))
    counted = runs.select("attempt", F.col("execution_id").alias("run"))
    return rows.join(counted, ["attempt", "run"], "left_semi").drop("attempt", "run")


def read_run(spark: SparkSession, base: str, name: str, execution_id: str) -> DataFrame:
    """Rows of a table of one run; only the run's own files are opened. Empty for a run that is not published."""
    schema = T.StructType([*LEDGER[name].schema.fields, *_PLACE])
    row = published_runs(spark, base).where(F.col("execution_id") == execution_id).first()
    path = table_path(base, name)
    if row is None:
        return spark.createDataFrame([], schema).drop("attempt", "run")
    rows = _read(spark, path, f"{path}/attempt={row['attempt']}", schema)
    return rows.where((F.col("run") == execution_id) & (F.col("attempt") == row["attempt"])).drop("attempt", "run")


def read_latest(spark: SparkSession, base: str, name: str, report_type: str) -> DataFrame:
    """Rows of a table of the newest successful run of a report."""
    row = latest_run(published_runs(spark, base), report_type).first()
    return read_run(spark, base, name, "" if row is None else row["execution_id"])


def publish(
    spark: SparkSession, base: str, runs: DataFrame, children: dict[str, DataFrame], max_rows_per_file: int = 5_000_000
) -> int:
    """Write runs that are not published yet with their rows, and return how many they are.

    Child rows belong to a run by ``execution_id``; rows of other runs are left out. Repeated records of one run are one,
    the newest by ``execution_ts``. A call that ends before the log is written has published nothing and can be repeated.
    """
    unknown = sorted(set(children) - set(LEDGER) | ({LOG} & set(children)))
    if unknown:
        raise ValueError(f"not child tables of the ledger: {', '.join(unknown)}")
    attempt = uuid.uuid4().hex
    newest = W.partitionBy("execution_id").orderBy(F.desc("execution_ts"), F.desc("status"))
    records = to_ledger(runs, LOG).withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    fresh = records.join(published_runs(spark, base).select("execution_id"), "execution_id", "left_anti").select(*records.columns)
    number = fresh.count()
    if not number:
        return 0
    for name, rows in children.items():
        write_child(rows.join(fresh.select("execution_id"), "execution_id", "left_semi"), base, name, attempt, max_rows_per_file)
    log = fresh.withColumn("attempt", F.lit(attempt)).repartition(1)  # a row per run, in one file: visible at once
    log.write.mode("append").parquet(table_path(base, LOG))
    return number


def write_child(rows: DataFrame, base: str, name: str, attempt: str, max_rows_per_file: int) -> None:
    """Rows of an attempt in a folder per run, sorted by the cluster keys; a large run is dealt over many tasks."""
    placed = to_ledger(rows, name).withColumn("run", F.col("execution_id")).hint("rebalance", "run")
    placed = placed.sortWithinPartitions("run", *LEDGER[name].cluster)
    placed.write.mode("errorifexists").option("maxRecordsPerFile", max_rows_per_file).partitionBy("run").parquet(f"{table_path(base, name)}/attempt={attempt}")


def unpublished(spark: SparkSession, base: str, name: str) -> DataFrame:
    """``attempt`` of the rows of ended calls that nothing reads; their folders may be deleted when no call is under way."""
    path = table_path(base, name)
    rows = _read(spark, path, path, T.StructType([*LEDGER[name].schema.fields, *_PLACE]))
    return rows.select("attempt").distinct().join(published_runs(spark, base).select("attempt"), "attempt", "left_anti")
