"""Run log, dashboards and tiles."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from bindings.registry import CHECK_VIEWS, query
from plumbline.constants import DIRECTIONS
from plumbline.functions.labels import output_url, short_id, status_label
from plumbline.operators import distinct, facts, runs
from plumbline.plans import dashboards, tiles
from plumbline.session import cut_lineage

AS_OF = date(2024, 3, 1)
BROWSER, BUCKET = "https://console.example/browser/", "bucket"
V = CHECK_VIEWS

# --- run log ---------------------------------------------------------------------------
SUCCESS = "count(*) FILTER (WHERE status = 'success')"
V["daily"] = f"""
SELECT cast(execution_ts AS date) AS execution_date, report_type, {SUCCESS} AS success_count,
       count(*) FILTER (WHERE status = 'failed') AS failure_count, count(*) AS total_count,
       {SUCCESS} / count(*) AS success_rate
FROM {{runs}} GROUP BY ALL"""


@query("latest_run", "SELECT * FROM {runs} WHERE report_type = 'env_drift' AND status = 'success' ORDER BY execution_ts DESC, execution_id LIMIT 1")
def _(v):
    return runs.latest_run(v.runs, "env_drift")


@query("latest_per_type", """
SELECT * FROM {runs} QUALIFY row_number() OVER (PARTITION BY report_type ORDER BY execution_ts DESC, execution_id) = 1""")
def _(v):
    return runs.latest_per_type(v.runs)


@query("recent_runs", "SELECT execution_id, report_type, execution_ts, status, gcs_path FROM {runs} ORDER BY execution_ts DESC, execution_id LIMIT 20")
def _(v):
    return runs.recent_runs(v.runs)


@query("run_after", """
SELECT execution_id, gcs_path, execution_ts FROM {runs} WHERE report_type = 'file_drift' AND execution_ts >= timestamp '2024-01-15 00:00:00'
ORDER BY execution_ts DESC, execution_id LIMIT 1""")
def _(v):
    return runs.run_after(v.runs, "file_drift", datetime(2024, 1, 15))


@query("daily_summary", "SELECT * FROM {daily}")
def _(v):
    return runs.daily_summary(v.runs)


@query("tile_success_rate", """
SELECT cast(sum(success_count) AS bigint) AS success_count, cast(sum(total_count) AS bigint) AS total_count, sum(success_count) / sum(total_count) AS success_rate
FROM {daily} WHERE execution_date BETWEEN date '2024-01-05' AND date '2024-01-25'""")
def _(v):
    return tiles.success_rate(runs.daily_summary(v.runs), date(2024, 1, 5), date(2024, 1, 25))


@query("tile_total_executions", "SELECT cast(sum(total_count) AS bigint) AS total_executions FROM {daily}")
def _(v):
    return tiles.total_executions(runs.daily_summary(v.runs))


@query("tile_run_trend", """
SELECT execution_date, report_type, cast(sum(success_count) AS bigint) AS success_count, cast(sum(failure_count) AS bigint) AS failure_count
FROM {daily} GROUP BY ALL""")
def _(v):
    return tiles.run_trend(runs.daily_summary(v.runs))


URL = """CASE WHEN gcs_path IS NOT NULL AND gcs_path <> '' THEN 'https://console.example/browser/' || regexp_replace(gcs_path, '^gs://', '')
     ELSE 'https://console.example/browser/bucket/' || report_type || '/' || execution_id END"""


@query("tile_latest_executions", f"""
SELECT report_type, execution_id, execution_ts, substring(execution_id, 1, 8) AS short_id, coalesce(status, 'unknown') AS status_label, {URL} AS output_url
FROM {{runs}} QUALIFY row_number() OVER (PARTITION BY report_type ORDER BY execution_ts DESC, execution_id) = 1""")
def _(v):
    return tiles.latest_executions(v.runs, BROWSER, BUCKET)


@query("run_links", f"""
SELECT execution_id, substring(execution_id, 1, 8) AS short_id, coalesce(nullif(status, 'skipped'), 'unknown') AS status_label, {URL} AS output_url FROM {{runs}}""")
def _(v):
    status = F.nullif("status", F.lit("skipped"))
    link = output_url(F.col("gcs_path"), F.col("report_type"), F.col("execution_id"), BROWSER, BUCKET)
    return v.runs.select(
        "execution_id", short_id(F.col("execution_id")).alias("short_id"), status_label(status).alias("status_label"), link.alias("output_url")
    )


# --- commit and file drift -------------------------------------------------------------
def label(verb: str) -> str:
    right = "nullif(regexp_extract(k.right_branch, 'origin/(.+)', 1), '')"
    left = "nullif(regexp_extract(k.left_branch, 'origin/(.+)', 1), '')"
    return f"{right} || ' {verb} ' || {left}"


def key(strict: bool) -> str:
    def part(side):
        branch = f"nullif(regexp_extract(k.{side}_branch, 'origin/(.+)', 1), '')"
        return branch if strict else f"replace({branch}, 'production', 'prod')"

    return f"{part('right')} || '_not_in_' || {part('left')}"


COMMIT_AGG = """
SELECT execution_id, repo, discrepancy, count(DISTINCT commit_sha) AS distinct_commits, count(DISTINCT author) AS distinct_authors,
       count(DISTINCT file_path) AS distinct_files, min(commit_date) AS earliest_commit_date, max(commit_date) AS latest_commit_date
FROM {evidence} WHERE drift_type = 'commit' GROUP BY ALL"""
FILE_AGG = """
SELECT execution_id, repo, discrepancy, count(DISTINCT file_path) AS distinct_files,
       count(*) FILTER (WHERE upper(change_type) = 'A') AS files_added, count(*) FILTER (WHERE upper(change_type) = 'M') AS files_modified,
       count(*) FILTER (WHERE upper(change_type) = 'D') AS files_deleted,
       count(*) FILTER (WHERE change_type IS NULL OR upper(change_type) NOT IN ('A', 'M', 'D')) AS files_other,
       count(DISTINCT author) AS distinct_authors, min(commit_date) AS earliest_change_date, max(commit_date) AS latest_change_date
FROM {evidence} WHERE drift_type = 'content' GROUP BY ALL"""
V["commit_agg"], V["file_agg"] = COMMIT_AGG, FILE_AGG


def commit_report_sql(strict: bool) -> str:
    return f"""
SELECT e.execution_ts, e.environment, e.triggered_by, k.repo, {label('not in')} AS drift_direction, k.left_branch, k.right_branch,
       k.unique_commits, k.unique_files, k.severity, k.status AS branch_status, k.comparison_mode,
       a.distinct_authors, a.earliest_commit_date, a.latest_commit_date
FROM {{kpis}} k JOIN {{latest_commit}} e USING (execution_id)
LEFT JOIN {{commit_agg}} a ON a.execution_id = e.execution_id AND a.repo = k.repo AND a.discrepancy = {key(strict)}
WHERE k.drift_type = 'commit' AND k.status = 'ok'"""


V["commit_report"] = commit_report_sql(False)
V["file_report"] = f"""
SELECT e.execution_ts, e.environment, e.triggered_by, k.repo, {label('differs from')} AS drift_direction, k.left_branch, k.right_branch,
       k.comparison_mode, k.unique_commits, k.unique_files, k.severity, k.status AS branch_status,
       a.distinct_authors, a.files_added, a.files_modified, a.files_deleted, a.files_other, a.earliest_change_date, a.latest_change_date
FROM {{kpis}} k JOIN {{latest_file}} e USING (execution_id)
LEFT JOIN {{file_agg}} a ON a.execution_id = e.execution_id AND a.repo = k.repo AND a.discrepancy = {key(False)}
WHERE k.drift_type = 'content' AND k.status = 'ok'"""


def commit_report(v, strict=False):
    return dashboards.commit_kpi_report(v.executions, v.kpis, v.evidence, strict)


def file_report(v):
    return dashboards.file_kpi_report(v.executions, v.kpis, v.evidence)


@query("commit_kpi_report", "SELECT * FROM {commit_report}")
def _(v):
    return commit_report(v)


@query("commit_kpi_report_strict_key", commit_report_sql(True))
def _(v):
    return commit_report(v, True)


@query("file_kpi_report", "SELECT * FROM {file_report}")
def _(v):
    return file_report(v)


@query("commit_evidence", "SELECT * FROM {commit_agg}")
def _(v):
    return facts.commit_evidence(v.evidence.where("drift_type = 'commit'"))


@query("file_evidence", "SELECT * FROM {file_agg}")
def _(v):
    return facts.file_evidence(v.evidence.where("drift_type = 'content'"))


V["commit_rows"] = "SELECT e.execution_ts, e.environment, f.* FROM {evidence} f JOIN {latest_commit} e USING (execution_id) WHERE f.drift_type = 'commit'"
V["file_rows"] = "SELECT e.execution_ts, e.environment, f.* FROM {evidence} f JOIN {latest_file} e USING (execution_id) WHERE f.drift_type = 'content'"


@query("commit_detail", """
SELECT execution_ts, environment, repo, discrepancy AS drift_direction, commit_sha, commit_date, author, file_path, problem_statement FROM {commit_rows}""")
def _(v):
    return dashboards.commit_detail(v.executions, v.evidence)


@query("file_detail", """
SELECT execution_ts, environment, repo, discrepancy AS drift_direction, file_path, change_type, author AS last_author,
       commit_sha AS last_commit_sha, commit_date AS last_commit_date, problem_statement FROM {file_rows}""")
def _(v):
    return dashboards.file_detail(v.executions, v.evidence)


LABELS = [f"{right} not in {left}" for _, left, right in DIRECTIONS]
CELLS = ", ".join(f"max(unique_commits) FILTER (WHERE drift_direction = '{d}') AS \"{d}\"" for d in LABELS)


@query("tile_severity_heat_map", f"SELECT repo, {CELLS} FROM {{commit_report}} GROUP BY repo")
def _(v):
    return tiles.heat_map(commit_report(v), "repo", "drift_direction", "unique_commits", F.max, LABELS)


@query("tile_top_repos", "SELECT repo, cast(sum(unique_commits) AS bigint) AS unique_commits FROM {commit_report} GROUP BY repo ORDER BY 2 DESC, 1 LIMIT 10")
def _(v):
    return tiles.top_n(commit_report(v), "repo", "unique_commits", 10)


@query("tile_top_file_repos", "SELECT repo, cast(sum(unique_files) AS bigint) AS unique_files FROM {file_report} GROUP BY repo ORDER BY 2 DESC, 1 LIMIT 15")
def _(v):
    return tiles.top_n(file_report(v), "repo", "unique_files", 15)


@query("tile_author_board", "SELECT author, count(DISTINCT commit_sha) AS commits_out_of_sync FROM {commit_rows} GROUP BY author")
def _(v):
    latest = runs.latest_run(v.executions, "commit_drift")
    return tiles.author_board(runs.at_latest(v.evidence, latest, []).where("drift_type = 'commit'"))


@query("tile_authors_per_repo", "SELECT repo, count(DISTINCT author) AS distinct_authors FROM {commit_rows} GROUP BY repo")
def _(v):
    latest = runs.latest_run(v.executions, "commit_drift")
    return tiles.authors_per_repo(runs.at_latest(v.evidence, latest, []).where("drift_type = 'commit'"))


def author_bitmaps(v, column):
    """Bitmaps per run, repository and author or month, written once and read by the tiles below."""
    rows = v.evidence.withColumn("month", F.date_trunc("month", "commit_date").cast("date"))
    numbers = cut_lineage(distinct.extend(None, rows, column), "numbers")
    return cut_lineage(distinct.bitmaps(rows, ["execution_id", "repo", "author", "month"], column, numbers), "bitmaps")


@query("authors_over_runs", "SELECT author, count(DISTINCT commit_sha) AS commits_out_of_sync FROM {evidence} GROUP BY author")
def _(v):
    return distinct.counts(author_bitmaps(v, "commit_sha"), ["author"], "commits_out_of_sync")


@query("repo_month_files", """
SELECT repo, cast(date_trunc('month', commit_date) AS date) AS month, count(DISTINCT file_path) AS distinct_files FROM {evidence} GROUP BY ALL""")
def _(v):
    return distinct.counts(author_bitmaps(v, "file_path"), ["repo", "month"], "distinct_files")


def timeline_sql(report: str) -> str:
    return f"""
SELECT e.execution_ts, cast(sum(k.unique_commits) AS bigint) AS unique_commits, cast(sum(k.unique_files) AS bigint) AS unique_files
FROM {{kpis}} k JOIN {{executions}} e USING (execution_id)
WHERE e.report_type = '{report}' AND e.status = 'success' AND k.status = 'ok' GROUP BY e.execution_ts"""


@query("tile_commit_timeline", timeline_sql("commit_drift"))
def _(v):
    return tiles.drift_timeline(v.executions, v.kpis, "commit_drift")


@query("tile_file_timeline", timeline_sql("file_drift"))
def _(v):
    return tiles.drift_timeline(v.executions, v.kpis, "file_drift")


@query("tile_change_breakdown", """
SELECT repo, cast(sum(files_added) AS bigint) AS files_added, cast(sum(files_modified) AS bigint) AS files_modified,
       cast(sum(files_deleted) AS bigint) AS files_deleted, cast(sum(files_other) AS bigint) AS files_other FROM {file_report} GROUP BY repo""")
def _(v):
    return tiles.change_breakdown(file_report(v))


@query("tile_hot_files", "SELECT file_path, count(DISTINCT repo) AS repo_count FROM {evidence} WHERE drift_type = 'content' GROUP BY file_path ORDER BY 2 DESC, 1 LIMIT 20")
def _(v):
    return tiles.hot_files(v.evidence.where("drift_type = 'content'"))


@query("cross_filter", """
SELECT * FROM {commit_report} WHERE severity IN ('low', 'medium') AND repo IN ('repo_1', 'repo_2', 'repo_3', 'repo_4')
  AND cast(execution_ts AS date) > date '2024-02-10' - 30 AND cast(execution_ts AS date) <= date '2024-02-10'""")
def _(v):
    recent = tiles.last_days(commit_report(v), "execution_ts", date(2024, 2, 10), 30)
    return tiles.choose(recent, severity=["low", "medium"], repo=["repo_1", "repo_2", "repo_3", "repo_4"], environment=None)


# --- environment drift -----------------------------------------------------------------
BLANK_SOURCE = "(source_hash IS NULL OR source_hash = '')"
BLANK_ENV = "(env_hash IS NULL OR env_hash = '')"
V["env_report"] = f"""
SELECT e.execution_ts, e.environment, e.triggered_by, e.git_ref, f.product, f.component_type, f.drift_category, f.severity,
       count(*) AS total_findings, count(DISTINCT f.object_name) AS distinct_objects,
       count(*) FILTER (WHERE {BLANK_SOURCE}) AS in_env_not_in_code, count(*) FILTER (WHERE {BLANK_ENV}) AS in_code_not_in_env,
       count(*) FILTER (WHERE NOT {BLANK_SOURCE} AND NOT {BLANK_ENV}) AS content_mismatch
FROM {{findings}} f JOIN {{latest_env}} e USING (execution_id) GROUP BY ALL"""
V["env_trend"] = """
SELECT e.execution_ts, e.environment, f.product, f.component_type, f.severity, count(*) AS total_findings
FROM {findings} f JOIN {executions} e USING (execution_id) WHERE e.report_type = 'env_drift' AND e.status = 'success' GROUP BY ALL"""


def env_report(v):
    return dashboards.env_summary_report(v.executions, v.findings)


def env_trend(v):
    return facts.env_trend(v.findings, v.executions)


@query("env_summary_report", "SELECT * FROM {env_report}")
def _(v):
    return env_report(v)


@query("env_trend", "SELECT * FROM {env_trend}")
def _(v):
    return env_trend(v)


@query("env_detail", """
SELECT e.execution_ts, e.environment, e.git_ref, f.product, f.component_type, f.object_type, f.object_name, f.drift_category, f.severity, f.source_hash, f.env_hash
FROM {findings} f JOIN {latest_env} e USING (execution_id)""")
def _(v):
    return dashboards.env_detail(v.executions, v.findings)


@query("env_latest_per_product", """
SELECT p.product, e.* FROM (SELECT DISTINCT product, execution_id FROM {findings}) p JOIN {executions} e USING (execution_id)
WHERE e.report_type = 'env_drift' AND e.status = 'success'
QUALIFY row_number() OVER (PARTITION BY p.product ORDER BY e.execution_ts DESC, e.execution_id) = 1""")
def _(v):
    return runs.latest_runs_by(v.findings, v.executions, "env_drift", "product")


@query("tile_findings_by_product", "SELECT product, component_type, cast(sum(total_findings) AS bigint) AS total_findings FROM {env_trend} GROUP BY ALL")
def _(v):
    return tiles.sum_by(env_trend(v), ["product", "component_type"], "total_findings")


@query("tile_severity_distribution", "SELECT severity, cast(sum(total_findings) AS bigint) AS total_findings FROM {env_report} GROUP BY ALL")
def _(v):
    return tiles.sum_by(env_report(v), ["severity"], "total_findings")


@query("tile_component_heat_map", "SELECT component_type, product, cast(sum(total_findings) AS bigint) AS total_findings FROM {env_report} GROUP BY ALL")
def _(v):
    return tiles.heat_map(env_report(v), "component_type", "product", "total_findings", F.sum)


@query("tile_top_unmanaged", """
SELECT product, component_type, drift_category, in_env_not_in_code, in_code_not_in_env, content_mismatch,
       greatest(in_env_not_in_code, in_code_not_in_env, content_mismatch) AS largest
FROM {env_report} WHERE severity = 'high' ORDER BY largest DESC, product, component_type, drift_category LIMIT 20""")
def _(v):
    return tiles.top_unmanaged(env_report(v))


@query("tile_findings_timeline", "SELECT execution_ts, cast(sum(total_findings) AS bigint) AS total_findings FROM {env_trend} GROUP BY ALL")
def _(v):
    return tiles.sum_by(env_trend(v), ["execution_ts"], "total_findings")


# --- orphan datasets -------------------------------------------------------------------
KIND = "replace(coalesce(object_type, ''), 'base_table', 'table')"
V["objects_agg"] = f"""
SELECT execution_id, dataset_name, count(DISTINCT object_name) AS object_count, cast(sum(row_count) AS bigint) AS total_row_count,
       cast(round(sum(storage_mb), 2) AS double) AS total_storage_mb, count(*) FILTER (WHERE {KIND} = 'table') AS table_objects,
       count(*) FILTER (WHERE {KIND} = 'view') AS view_objects, count(*) FILTER (WHERE {KIND} NOT IN ('table', 'view')) AS other_objects,
       max(last_modified) AS most_recent_object_change
FROM {{orphan_objects}} GROUP BY ALL"""
V["orphan_report"] = """
SELECT e.execution_ts, e.environment, e.triggered_by, d.project_id, d.dataset_name, d.orphan_status, d.source_reference_found, d.owner,
       d.risk_score, d.last_modified AS dataset_last_modified, date_diff('day', cast(d.last_modified AS date), date '2024-03-01') AS days_since_modified,
       d.table_count AS reported_table_count, coalesce(o.object_count, 0) AS scanned_object_count, coalesce(o.table_objects, 0) AS scanned_tables,
       coalesce(o.view_objects, 0) AS scanned_views, coalesce(o.other_objects, 0) AS scanned_other_objects,
       coalesce(o.total_row_count, 0) AS total_row_count, coalesce(o.total_storage_mb, 0) AS total_storage_mb, o.most_recent_object_change
FROM {orphans} d JOIN {latest_orphan} e USING (execution_id)
LEFT JOIN {objects_agg} o ON o.execution_id = d.execution_id AND o.dataset_name = d.dataset_name"""


def orphan_report(v):
    report = dashboards.orphan_summary_report(v.executions, v.orphans, v.orphan_objects, AS_OF)
    return report.withColumn("dataset_last_modified", F.col("dataset_last_modified").cast("timestamp_ntz"))


@query("orphan_summary_report", "SELECT * FROM {orphan_report}")
def _(v):
    return orphan_report(v)


@query("orphan_objects_rollup", "SELECT * FROM {objects_agg}")
def _(v):
    return facts.orphan_objects(v.orphan_objects)


@query("orphan_status_report", """
SELECT e.execution_ts, e.environment, d.orphan_status, d.project_id, count(*) AS dataset_count,
       count(*) FILTER (WHERE NOT d.source_reference_found) AS no_code_reference, cast(sum(d.table_count) AS bigint) AS total_tables,
       round(avg(d.risk_score), 1) AS avg_risk_score, max(d.risk_score) AS max_risk_score
FROM {orphans} d JOIN {latest_orphan} e USING (execution_id) GROUP BY ALL""")
def _(v):
    return dashboards.orphan_status_report(v.executions, v.orphans)


@query("orphan_detail", """
SELECT e.execution_ts, e.environment, d.project_id, d.dataset_name, d.orphan_status, d.risk_score, d.owner, o.object_type, o.object_name,
       o.last_modified, o.row_count, cast(round(o.storage_mb, 4) AS double) AS storage_mb
FROM {orphan_objects} o JOIN {latest_orphan} e USING (execution_id)
JOIN {orphans} d ON d.execution_id = o.execution_id AND d.dataset_name = o.dataset_name""")
def _(v):
    return dashboards.orphan_detail(v.executions, v.orphans, v.orphan_objects)


@query("tile_orphan_counts", "SELECT orphan_status, count(DISTINCT dataset_name) AS dataset_count FROM {orphan_report} GROUP BY ALL")
def _(v):
    return tiles.orphan_counts(orphan_report(v))


@query("tile_storage_at_risk", """
SELECT coalesce(cast(sum(cast(total_storage_mb AS decimal(18,2))) AS double), 0.0) AS storage_at_risk_mb FROM {orphan_report} WHERE orphan_status = 'orphan'""")
def _(v):
    return tiles.storage_at_risk(orphan_report(v))


@query("tile_top_owners", "SELECT owner, count(DISTINCT dataset_name) AS dataset_count FROM {orphan_report} GROUP BY owner ORDER BY 2 DESC, 1 NULLS LAST LIMIT 20")
def _(v):
    return tiles.top_owners(orphan_report(v))


@query("tile_risk_histogram", """
SELECT CASE WHEN risk_score <= 25 THEN '0-25' WHEN risk_score <= 50 THEN '26-50' WHEN risk_score <= 75 THEN '51-75' WHEN risk_score <= 100 THEN '76-100' ELSE '101+' END AS risk_bucket,
       count(*) AS dataset_count FROM {orphans} GROUP BY ALL""")
def _(v):
    return tiles.risk_histogram(v.orphans)


@query("tile_orphan_timeline", """
SELECT e.execution_ts, count(DISTINCT d.dataset_name) AS dataset_count FROM {orphans} d JOIN {executions} e USING (execution_id)
WHERE e.report_type = 'orphan_datasets' AND e.status = 'success' GROUP BY ALL""")
def _(v):
    return tiles.orphan_timeline(v.executions, v.orphans)
