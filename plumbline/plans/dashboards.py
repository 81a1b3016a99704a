"""The dashboard queries on the ledger: main reports and drill-throughs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.labels import days_since, direction, discrepancy_key, severity_rank, zero
from plumbline.operators import facts
from plumbline.operators.runs import at_latest, latest_run


def order_drift(df: DataFrame, measure: str, *names: str) -> DataFrame:
    """Severity first, then the measure from high to low, then names."""
    return df.orderBy(severity_rank(F.col("severity")), F.desc(measure), *names)


def _kpi_rows(runs: DataFrame, kpis: DataFrame, report: str, drift: str, verb: str) -> tuple[DataFrame, DataFrame]:
    latest = latest_run(runs, report)
    rows = at_latest(kpis, latest, ["execution_ts", "environment", "triggered_by"]).where(
        (F.col("drift_type") == drift) & (F.col("status") == "ok")
    )
    right, left = F.col("right_branch"), F.col("left_branch")
    return latest, rows.withColumn("drift_direction", direction(right, left, verb))


def commit_kpi_report(runs: DataFrame, kpis: DataFrame, evidence: DataFrame, strict_key: bool = False) -> DataFrame:
    """Commit drift of the latest run per repository and direction, with its evidence."""
    latest, rows = _kpi_rows(runs, kpis, "commit_drift", "commit", "not in")
    found = facts.commit_evidence(at_latest(evidence, latest, []).where(F.col("drift_type") == "commit"))
    found = found.select("repo", "discrepancy", "distinct_authors", "earliest_commit_date", "latest_commit_date")
    keyed = rows.withColumn("discrepancy", discrepancy_key(F.col("right_branch"), F.col("left_branch"), strict_key))
    report = keyed.join(found, ["repo", "discrepancy"], "left").select(
        "execution_ts", "environment", "triggered_by", "repo", "drift_direction", "left_branch", "right_branch",
        "unique_commits", "unique_files", "severity", F.col("status").alias("branch_status"), "comparison_mode",
        "distinct_authors", "earliest_commit_date", "latest_commit_date",
    )
    return order_drift(report, "unique_commits", "repo", "left_branch")


def file_kpi_report(runs: DataFrame, kpis: DataFrame, evidence: DataFrame, strict_key: bool = False) -> DataFrame:
    """File drift of the latest run per repository and direction, with change-type counts."""
    latest, rows = _kpi_rows(runs, kpis, "file_drift", "content", "differs from")
    found = facts.file_evidence(at_latest(evidence, latest, []).where(F.col("drift_type") == "content"))
    found = found.drop("execution_id", "distinct_files")
    keyed = rows.withColumn("discrepancy", discrepancy_key(F.col("right_branch"), F.col("left_branch"), strict_key))
    report = keyed.join(found, ["repo", "discrepancy"], "left").select(
        "execution_ts", "environment", "triggered_by", "repo", "drift_direction", "left_branch", "right_branch",
        "comparison_mode", "unique_commits", "unique_files", "severity", F.col("status").alias("branch_status"),
        "distinct_authors", "files_added", "files_modified", "files_deleted", "files_other",
        "earliest_change_date", "latest_change_date",
    )
    return order_drift(report, "unique_files", "repo", "left_branch")


def commit_detail(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    rows = at_latest(evidence, latest_run(runs, "commit_drift"), ["execution_ts", "environment"])
    return rows.where(F.col("drift_type") == "commit").select(
        "execution_ts", "environment", "repo", F.col("discrepancy").alias("drift_direction"),
        "commit_sha", "commit_date", "author", "file_path", "problem_statement",
    ).orderBy("repo", "drift_direction", F.desc("commit_date"), "commit_sha", "file_path")


def file_detail(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    rows = at_latest(evidence, latest_run(runs, "file_drift"), ["execution_ts", "environment"])
    return rows.where(F.col("drift_type") == "content").select(
        "execution_ts", "environment", "repo", F.col("discrepancy").alias("drift_direction"), "file_path",
        "change_type", F.col("author").alias("last_author"), F.col("commit_sha").alias("last_commit_sha"),
        F.col("commit_date").alias("last_commit_date"), "problem_statement",
    ).orderBy("repo", "drift_direction", "file_path")


ENV_RUN = ["execution_ts", "environment", "triggered_by", "git_ref"]


def env_summary_report(runs: DataFrame, findings: DataFrame) -> DataFrame:
    rows = at_latest(findings, latest_run(runs, "env_drift"), ENV_RUN)
    summary = facts.env_summary(rows, ENV_RUN)
    ordered = summary.orderBy("severity_sort", F.desc("total_findings"), "product", "component_type")
    return ordered.drop("severity_sort")


def env_detail(runs: DataFrame, findings: DataFrame) -> DataFrame:
    rows = at_latest(findings, latest_run(runs, "env_drift"), ["execution_ts", "environment", "git_ref"])
    columns = [
        "execution_ts", "environment", "git_ref", "product", "component_type", "object_type", "object_name",
        "drift_category", "severity", "source_hash", "env_hash",
    ]
    rank = severity_rank(F.col("severity"), levels=3)
    return rows.select(*columns).orderBy(rank, "product", "component_type", "object_name")


def orphan_summary_report(runs: DataFrame, datasets: DataFrame, objects: DataFrame, as_of: date) -> DataFrame:
    """Datasets of the latest orphan run with what was scanned in them."""
    latest = latest_run(runs, "orphan_datasets")
    rows = at_latest(datasets, latest, ["execution_ts", "environment", "triggered_by"])
    scanned = facts.orphan_objects(at_latest(objects, latest, []))
    joined = rows.join(scanned, ["execution_id", "dataset_name"], "left")
    report = joined.select(
        "execution_ts", "environment", "triggered_by", "project_id", "dataset_name", "orphan_status",
        "source_reference_found", "owner", "risk_score",
        F.col("last_modified").alias("dataset_last_modified"),
        days_since(F.col("last_modified"), F.lit(as_of)).alias("days_since_modified"),
        F.col("table_count").alias("reported_table_count"),
        zero(F.col("object_count")).alias("scanned_object_count"),
        zero(F.col("table_objects")).alias("scanned_tables"),
        zero(F.col("view_objects")).alias("scanned_views"),
        zero(F.col("other_objects")).alias("scanned_other_objects"),
        zero(F.col("total_row_count")).alias("total_row_count"),
        F.coalesce("total_storage_mb", F.lit(0.0)).alias("total_storage_mb"),
        "most_recent_object_change",
    )
    return order_orphans(report)


def order_orphans(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("risk_score"), F.desc("total_storage_mb"), "dataset_name")


def orphan_status_report(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    run = ["execution_ts", "environment"]
    rows = at_latest(datasets, latest_run(runs, "orphan_datasets"), run)
    return facts.orphan_status(rows, run).orderBy("orphan_status", F.desc("dataset_count"), "project_id")


def orphan_detail(runs: DataFrame, datasets: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects of the latest run's datasets."""
    latest = latest_run(runs, "orphan_datasets")
    owners = at_latest(datasets, latest, []).select(
        "execution_id", "dataset_name", "project_id", "orphan_status", "risk_score", "owner"
    )
    rows = at_latest(objects, latest, ["execution_ts", "environment"]).join(owners, ["execution_id", "dataset_name"])
    return rows.select(
        "execution_ts", "environment", "project_id", "dataset_name", "orphan_status", "risk_score", "owner",
        "object_type", "object_name", "last_modified", "row_count",
        F.round(F.col("storage_mb").cast("decimal(18,4)"), 4).cast("double").alias("storage_mb"),
    ).orderBy(F.desc("risk_score"), "dataset_name", "object_type", "object_name")
