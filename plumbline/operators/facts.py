"""Aggregates of ledger facts behind the dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.labels import canonical_type, is_blank, is_present, severity_rank
from plumbline.operators.runs import successful


def commit_evidence(evidence: DataFrame) -> DataFrame:
    """Distinct commits, authors and files, and the date range, per repository and direction.

    Spark expands distinct counts and groups by the counted value first, so a
    repository with a third of the rows is spread over its commits and files.
    """
    return evidence.groupBy("execution_id", "repo", "discrepancy").agg(
        F.countDistinct("commit_sha").alias("distinct_commits"),
        F.countDistinct("author").alias("distinct_authors"),
        F.countDistinct("file_path").alias("distinct_files"),
        F.min("commit_date").alias("earliest_commit_date"),
        F.max("commit_date").alias("latest_commit_date"),
    )


def change_count(letter: str) -> Column:
    return F.count_if(F.upper("change_type") == letter)


def file_evidence(evidence: DataFrame) -> DataFrame:
    """As :func:`commit_evidence` for changed files, with counts by change letter."""
    known = F.coalesce(F.upper("change_type").isin("A", "M", "D"), F.lit(False))
    return evidence.groupBy("execution_id", "repo", "discrepancy").agg(
        F.countDistinct("file_path").alias("distinct_files"),
        change_count("A").alias("files_added"),
        change_count("M").alias("files_modified"),
        change_count("D").alias("files_deleted"),
        F.count_if(~known).alias("files_other"),
        F.countDistinct("author").alias("distinct_authors"),
        F.min("commit_date").alias("earliest_change_date"),
        F.max("commit_date").alias("latest_change_date"),
    )


def env_summary(findings: DataFrame, run_columns: list[str]) -> DataFrame:
    source, env = F.col("source_hash"), F.col("env_hash")
    return (
        findings.groupBy(*run_columns, "product", "component_type", "drift_category", "severity")
        .agg(
            F.count(F.lit(1)).alias("total_findings"),
            F.countDistinct("object_name").alias("distinct_objects"),
            F.count_if(is_blank(source)).alias("in_env_not_in_code"),
            F.count_if(is_blank(env)).alias("in_code_not_in_env"),
            F.count_if(is_present(source) & is_present(env)).alias("content_mismatch"),
        )
        .withColumn("severity_sort", severity_rank(F.col("severity")))
    )


def env_trend(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Finding counts of all successful runs.

    Findings are counted per run first: the join with the runs then moves one
    row per group instead of one per finding.
    """
    counted = findings.groupBy("execution_id", "product", "component_type", "severity").agg(
        F.count(F.lit(1)).alias("n")
    )
    kept = successful(runs, "env_drift").select("execution_id", "execution_ts", "environment")
    return (
        counted.join(kept, "execution_id")
        .groupBy("execution_ts", "environment", "product", "component_type", "severity")
        .agg(F.sum("n").alias("total_findings"))
        .orderBy(F.desc("execution_ts"), "product", "component_type", "severity")
    )


def orphan_objects(objects: DataFrame) -> DataFrame:
    """Objects, rows, storage and newest change per dataset.

    Catalog type names are brought to one form before counting; an unknown type
    counts as other. Storage is summed as a decimal, so the sum has no order.
    """
    kind = canonical_type(F.col("object_type"))
    return objects.groupBy("execution_id", "dataset_name").agg(
        F.countDistinct("object_name").alias("object_count"),
        F.sum("row_count").alias("total_row_count"),
        F.round(F.sum(F.col("storage_mb").cast("decimal(18,4)")), 2).cast("double").alias("total_storage_mb"),
        F.count_if(kind == "table").alias("table_objects"),
        F.count_if(kind == "view").alias("view_objects"),
        F.count_if(~kind.isin("table", "view")).alias("other_objects"),
        F.max("last_modified").alias("most_recent_object_change"),
    )


def orphan_status(datasets: DataFrame, run_columns: list[str]) -> DataFrame:
    return datasets.groupBy(*run_columns, "orphan_status", "project_id").agg(
        F.count(F.lit(1)).alias("dataset_count"),
        F.count_if(~F.col("source_reference_found")).alias("no_code_reference"),
        F.sum("table_count").alias("total_tables"),
        F.round(F.avg("risk_score"), 1).alias("avg_risk_score"),
        F.max("risk_score").alias("max_risk_score"),
    )
