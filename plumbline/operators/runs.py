"""Queries on the run log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.functions.labels import ratio


def newest_first() -> list:
    return [F.desc("execution_ts"), F.asc("execution_id")]


def successful(runs: DataFrame, report_type: str) -> DataFrame:
    return runs.where((F.col("report_type") == report_type) & (F.col("status") == "success"))


def latest_run(runs: DataFrame, report_type: str) -> DataFrame:
    """The newest successful run of a report; one row at most, kept by a top-1 per task."""
    return successful(runs, report_type).orderBy(*newest_first()).limit(1)


def latest_per_type(runs: DataFrame) -> DataFrame:
    newest = W.partitionBy("report_type").orderBy(*newest_first())
    ranked = runs.withColumn("_rank", F.row_number().over(newest))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def at_latest(fact: DataFrame, latest: DataFrame, run_columns: list[str]) -> DataFrame:
    """Fact rows of one run, with columns of that run.

    The id is compared as a scalar subquery, which reaches the parquet scan as
    a filter; the broadcast side is the single run. Rows are found by the id
    alone, whatever their ``run_date`` says.
    """
    latest = latest.limit(1)
    wanted = latest.select("execution_id").scalar()
    run = F.broadcast(latest.select("execution_id", *run_columns))
    return fact.where(F.col("execution_id") == wanted).join(run, "execution_id")


def latest_runs_by(fact: DataFrame, runs: DataFrame, report_type: str, key: str) -> DataFrame:
    """The newest successful run per ``key`` of the fact, for reports written one run per key."""
    pairs = fact.select(key, "execution_id").distinct()
    dated = pairs.join(successful(runs, report_type), "execution_id")
    newest = W.partitionBy(key).orderBy(*newest_first())
    return dated.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") == 1).drop("_rank")


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    columns = ["execution_id", "report_type", "execution_ts", "status", "gcs_path"]
    return runs.select(*columns).orderBy(*newest_first()).limit(n)


def run_after(runs: DataFrame, report_type: str, after: datetime) -> DataFrame:
    """The newest run of a report at or after an instant."""
    found = runs.where((F.col("report_type") == report_type) & (F.col("execution_ts") >= F.lit(after)))
    return found.select("execution_id", "gcs_path", "execution_ts").orderBy(*newest_first()).limit(1)


def run_exists(runs: DataFrame, execution_id: str) -> bool:
    return not runs.where(F.col("execution_id") == execution_id).limit(1).isEmpty()


def daily_summary(runs: DataFrame) -> DataFrame:
    """Successes, failures, all runs and success rate per day and report."""
    counted = runs.groupBy(F.to_date("execution_ts").alias("execution_date"), "report_type").agg(
        F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "failed").alias("failure_count"),
        F.count(F.lit(1)).alias("total_count"),
    )
    return counted.withColumn("success_rate", ratio(F.col("success_count"), F.col("total_count")))
