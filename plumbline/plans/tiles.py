"""Dashboard tiles; each is an aggregation or a selection on a ledger table or a main report."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.labels import output_url, short_id, status_label
from plumbline.operators.runs import latest_per_type, successful


def success_rate(daily: DataFrame, since: date | None = None, until: date | None = None) -> DataFrame:
    """Success rate over the chosen dates of the daily summary."""
    rows = between(daily, "execution_date", since, until)
    sums = rows.agg(F.sum("success_count").alias("success_count"), F.sum("total_count").alias("total_count"))
    return sums.withColumn("success_rate", F.try_divide("success_count", "total_count"))


def total_executions(daily: DataFrame) -> DataFrame:
    return daily.agg(F.sum("total_count").alias("total_executions"))


def run_trend(daily: DataFrame) -> DataFrame:
    return daily.groupBy("execution_date", "report_type").agg(
        F.sum("success_count").alias("success_count"), F.sum("failure_count").alias("failure_count")
    )


def latest_executions(runs: DataFrame, browser: str, bucket: str) -> DataFrame:
    """The latest run per report with display id, status and a link to its output."""
    link = output_url(F.col("gcs_path"), F.col("report_type"), F.col("execution_id"), browser, bucket)
    return latest_per_type(runs).select(
        "report_type", "execution_id", "execution_ts", short_id(F.col("execution_id")).alias("short_id"),
        status_label(F.col("status")).alias("status_label"), link.alias("output_url"),
    )


def heat_map(df: DataFrame, row: str, column: str, measure: str, how, values: Sequence[str] | None = None) -> DataFrame:
    """Two-way table. With ``values`` a column per value, else one row per cell."""
    if values is None:
        return df.groupBy(row, column).agg(how(measure).alias(measure))
    return df.groupBy(row).pivot(column, list(values)).agg(how(measure))


def top_n(df: DataFrame, key: str, measure: str, k: int = 15) -> DataFrame:
    """The keys with the highest summed measure."""
    summed = df.groupBy(key).agg(F.sum(measure).alias(measure))
    return summed.orderBy(F.desc(measure), key).limit(k)


def change_breakdown(file_report: DataFrame) -> DataFrame:
    measures = ["files_added", "files_modified", "files_deleted", "files_other"]
    return file_report.groupBy("repo").agg(*[F.sum(m).alias(m) for m in measures])


def author_board(evidence: DataFrame) -> DataFrame:
    """Commits out of sync per author."""
    counted = evidence.groupBy("author").agg(F.countDistinct("commit_sha").alias("commits_out_of_sync"))
    return counted.orderBy(F.desc("commits_out_of_sync"), "author")


def authors_per_repo(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("repo").agg(F.countDistinct("author").alias("distinct_authors"))


def drift_timeline(runs: DataFrame, kpis: DataFrame, report_type: str) -> DataFrame:
    """Commits and files of each successful run; KPI rows are added up per run before the join."""
    per_run = kpis.where(F.col("status") == "ok").groupBy("execution_id").agg(
        F.sum("unique_commits").alias("unique_commits"), F.sum("unique_files").alias("unique_files")
    )
    dated = per_run.join(successful(runs, report_type).select("execution_id", "execution_ts"), "execution_id")
    return dated.groupBy("execution_ts").agg(
        F.sum("unique_commits").alias("unique_commits"), F.sum("unique_files").alias("unique_files")
    )


def hot_files(evidence: DataFrame, k: int = 20) -> DataFrame:
    """Paths that drift in the most repositories."""
    counted = evidence.groupBy("file_path").agg(F.countDistinct("repo").alias("repo_count"))
    return counted.orderBy(F.desc("repo_count"), "file_path").limit(k)


def sum_by(df: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(measure).alias(measure))


def top_unmanaged(env_report: DataFrame, k: int = 20) -> DataFrame:
    """High-severity groups by their largest mismatch count."""
    measures = ["in_env_not_in_code", "in_code_not_in_env", "content_mismatch"]
    largest = env_report.where(F.col("severity") == "high").withColumn("largest", F.greatest(*measures))
    names = ["product", "component_type", "drift_category"]
    return largest.select(*names, *measures, "largest").orderBy(F.desc("largest"), *names).limit(k)


def orphan_counts(orphan_report: DataFrame) -> DataFrame:
    return orphan_report.groupBy("orphan_status").agg(F.countDistinct("dataset_name").alias("dataset_count"))


def storage_at_risk(orphan_report: DataFrame) -> DataFrame:
    """Storage of confirmed orphans; added as decimals, so the sum has no order."""
    confirmed = orphan_report.where(F.col("orphan_status") == "orphan")
    total = F.sum(F.col("total_storage_mb").cast("decimal(18,2)"))
    return confirmed.agg(F.coalesce(total.cast("double"), F.lit(0.0)).alias("storage_at_risk_mb"))


def top_owners(orphan_report: DataFrame, k: int = 20) -> DataFrame:
    counted = orphan_report.groupBy("owner").agg(F.countDistinct("dataset_name").alias("dataset_count"))
    return counted.orderBy(F.desc("dataset_count"), F.asc_nulls_last("owner")).limit(k)


def risk_histogram(orphan_report: DataFrame, uppers: Sequence[int] = (25, 50, 75, 100)) -> DataFrame:
    """Datasets per score bucket; a bucket includes its upper bound."""
    score, low = F.col("risk_score"), 0
    bucket = None
    for upper in uppers:
        label = F.lit(f"{low}-{upper}")
        bucket = F.when(score <= upper, label) if bucket is None else bucket.when(score <= upper, label)
        low = upper + 1
    bucket = bucket.otherwise(F.lit(f"{low}+"))
    return orphan_report.groupBy(bucket.alias("risk_bucket")).agg(F.count(F.lit(1)).alias("dataset_count"))


def orphan_timeline(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    dated = datasets.join(successful(runs, "orphan_datasets").select("execution_id", "execution_ts"), "execution_id")
    return dated.groupBy("execution_ts").agg(F.countDistinct("dataset_name").alias("dataset_count"))


def between(df: DataFrame, column: str, since: date | None = None, until: date | None = None) -> DataFrame:
    if since is not None:
        df = df.where(F.col(column) >= F.lit(since))
    if until is not None:
        df = df.where(F.col(column) <= F.lit(until))
    return df


def last_days(df: DataFrame, ts: str, as_of: date, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` days up to ``as_of``."""
    day = F.to_date(ts)
    return df.where((day > F.date_sub(F.lit(as_of), days)) & (day <= F.lit(as_of)))


def choose(df: DataFrame, **chosen) -> DataFrame:
    """Cross filters: keep rows whose columns hold one of the chosen values; None keeps all."""
    for column, values in chosen.items():
        if values is not None:
            df = df.where(F.col(column).isin(list(values)))
    return df
