"""Executive summaries over report rows.

``totals`` holds repo, discrepancy, unique_files_affected, unique_commits, status
as report strings; ``details`` the detail rows; ``matrix`` the commit matrix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.constants import MATRIX_ORDER, MESSAGE_SIGNALS
from plumbline.functions.labels import int_or_zero
from plumbline.functions.text import parse_ts
from plumbline.operators.reconcile import one_row


def _files() -> Column:
    return int_or_zero(F.col("unique_files_affected"))


def _ok(totals: DataFrame) -> DataFrame:
    return totals.where(F.col("status") == "ok")


def repo_alignment(totals: DataFrame) -> DataFrame:
    counted = _ok(totals).groupBy("repo").agg(F.count_if(_files() > 0).alias("nonzero_pairs"))
    return counted.withColumn("aligned", F.col("nonzero_pairs") == 0)


def exec_summary(totals: DataFrame, details: DataFrame, matrix: DataFrame, date_tag: str) -> DataFrame:
    """The one-row summary: repository, pair and detail counts, date range and sums per direction."""
    ok = F.col("status") == "ok"
    per_repo = totals.groupBy("repo").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(ok).alias("ok_pairs"),
        F.count_if(ok & (_files() > 0)).alias("nonzero"),
        *[F.sum(F.when(ok & (F.col("discrepancy") == d), _files())).alias(f"f_{d}") for d in SUMMED_FILES],
    )
    pairs = per_repo.agg(
        F.count(F.lit(1)).alias("total_repos"),
        F.sum("pairs").alias("total_repo_discrepancy_pairs"),
        F.sum("ok_pairs").alias("pairs_ok"),
        (F.sum("pairs") - F.sum("ok_pairs")).alias("pairs_with_missing_branch"),
        F.sum("nonzero").alias("pairs_with_nonzero_files"),
        F.count_if(F.col("ok_pairs") > 0).alias("repos_with_complete_branches"),
        F.count_if((F.col("ok_pairs") > 0) & (F.col("nonzero") == 0)).alias("repos_fully_aligned"),
        F.count_if(F.col("nonzero") > 0).alias("repos_with_any_discrepancy"),
        *[F.coalesce(F.sum(f"f_{d}"), F.lit(0)).alias(f"sum_unique_files_{d}") for d in SUMMED_FILES],
    )
    created = parse_ts(F.col("created_at").cast("string"))
    rows = details.agg(
        F.count(F.lit(1)).alias("total_detail_rows"),
        F.countDistinct("file_path").alias("total_unique_files_across_detail"),
        F.countDistinct("commit").alias("total_unique_commits_across_detail"),
        F.coalesce(F.date_format(F.min(created), "yyyy-MM-dd HH:mm:ss xxx"), F.lit("")).alias("min_discrepancy_commit_date"),
        F.coalesce(F.date_format(F.max(created), "yyyy-MM-dd HH:mm:ss xxx"), F.lit("")).alias("max_discrepancy_commit_date"),
    )
    commits = matrix.agg(
        *[
            F.coalesce(F.sum(int_or_zero(F.col(f"{d}_commits_no_merges"))), F.lit(0)).alias(f"sum_commits_{d}")
            for d in MATRIX_ORDER
        ]
    )
    return one_row(pairs, rows, commits).select(F.lit(date_tag).alias("date_tag"), "*")


# Directions whose file counts the summary adds up.
SUMMED_FILES = ["prod_not_in_test", "prod_not_in_master", "test_not_in_prod", "master_not_in_prod"]


def top_repos(totals: DataFrame) -> DataFrame:
    ranked = _ok(totals).groupBy("repo").agg(
        F.sum(_files()).alias("total_unique_files"), F.count_if(_files() > 0).alias("nonzero_pairs")
    )
    return ranked.orderBy(F.desc("total_unique_files"), "repo")


def by_discrepancy(totals: DataFrame) -> DataFrame:
    return (
        _ok(totals)
        .groupBy("discrepancy")
        .agg(
            F.countDistinct(F.when(_files() > 0, F.col("repo"))).alias("repos_with_nonzero"),
            F.sum(_files()).alias("sum_unique_files"),
            F.sum(int_or_zero(F.col("unique_commits"))).alias("sum_unique_commits"),
        )
        .orderBy("discrepancy")
    )


def contributors(details: DataFrame) -> DataFrame:
    return (
        details.groupBy("author")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.countDistinct("commit").alias("unique_commits"),
            F.countDistinct("file_path").alias("unique_files"),
        )
        .orderBy(F.desc("rows"), "author")
    )


def contributors_normalized(details: DataFrame) -> DataFrame:
    """Contributors with the external marker removed from their names."""
    plain = F.regexp_replace("author", r"(?i) \(External\)$", "")
    return contributors(details.withColumn("author", plain))


def message_signals(details: DataFrame) -> DataFrame:
    """Rows whose message contains each phrase, ignoring case; phrases without rows count 0.

    All phrases are counted in one pass and unfolded from the single result row.
    """
    message = F.lower("message")
    counts = details.agg(
        *[F.count_if(message.contains(s.lower())).alias(f"s{i}") for i, s in enumerate(MESSAGE_SIGNALS)]
    )
    pairs = F.array(
        *[F.struct(F.lit(s).alias("signal"), F.col(f"s{i}").alias("row_count")) for i, s in enumerate(MESSAGE_SIGNALS)]
    )
    return counts.select(F.inline(pairs))


def domain_month_type(details: DataFrame) -> DataFrame:
    """Detail rows, commits and files per domain (first path part), month and direction."""
    domain = F.split_part("file_path", F.lit("/"), F.lit(1))
    return details.groupBy(
        domain.alias("domain"), F.date_format("created_at", "yyyy-MM").alias("month_year"), "discrepancy"
    ).agg(
        F.count(F.lit(1)).alias("detail_rows"),
        F.countDistinct("commit").alias("unique_commits"),
        F.countDistinct("file_path").alias("unique_files"),
    )


def domain_month(by_type: DataFrame) -> DataFrame:
    """Sums over directions; the distinct counts are added up, not counted anew."""
    return (
        by_type.groupBy("domain", "month_year")
        .agg(*[F.sum(c).alias(c) for c in ("detail_rows", "unique_commits", "unique_files")])
        .orderBy("domain", "month_year")
    )


def count_rows(**frames: DataFrame) -> DataFrame:
    """Row count of each frame as one row, for run summaries."""
    return one_row(*[df.agg(F.count(F.lit(1)).alias(name)) for name, df in frames.items()])
