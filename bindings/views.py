"""Ledger and input tables derived from the given tables.

One SQL text per view, in expressions Spark and the checking engine read alike.
``{name}`` refers to a given table or to another view. Every view reads its
tables whole; presence on a side is set per row, not by dropping ids up front.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

REPORT_TYPE = (
    "CASE event_type WHEN 'click' THEN 'commit_drift' WHEN 'view' THEN 'file_drift'"
    " WHEN 'purchase' THEN 'env_drift' ELSE 'orphan_datasets' END"
)
PATH = "concat('dir_', cast(l_partkey % 10 AS string), '/f_', cast(l_partkey AS string), '.sql')"
DISCREPANCY = (
    "CASE l_partkey % 6 WHEN 0 THEN 'prod_not_in_master' WHEN 1 THEN 'prod_not_in_test'"
    " WHEN 2 THEN 'test_not_in_master' WHEN 3 THEN 'test_not_in_prod'"
    " WHEN 4 THEN 'master_not_in_test' ELSE 'master_not_in_prod' END"
)


def run_of(report: str, key: str) -> str:
    """Id of the daily run a fact belongs to; the runs span the days of one month."""
    return f"concat('{report}-202401', lpad(cast({key} % 31 + 1 AS string), 2, '0'))"


def remote(side: str) -> str:
    """Remote ref of one side of a discrepancy name (``prod_not_in_test`` …)."""
    part = "split_part(discrepancy, '_not_in_', %d)" % (1 if side == "right" else 2)
    return f"concat('origin/', CASE WHEN {part} = 'prod' THEN 'production' ELSE {part} END)"


VIEWS: dict[str, str] = {}

# --- the run log: every event is a run -------------------------------------------------
VIEWS["runs"] = f"""
SELECT cast(event_id AS string) AS execution_id, {REPORT_TYPE} AS report_type, ts AS execution_ts,
       CASE WHEN user_id % 4 = 0 THEN 'test' ELSE 'prod' END AS environment,
       CASE WHEN event_id % 2 = 0 THEN 'production' END AS git_ref, 'branch' AS source_mode,
       concat('user_', cast(user_id AS string)) AS triggered_by,
       CASE WHEN value < 5 THEN 'failed' WHEN value < 10 THEN 'skipped' ELSE 'success' END AS status,
       cast(floor(value) AS bigint) AS duration_seconds,
       CASE WHEN event_id % 5 <> 0 THEN concat('gs://bucket/', event_type, '/', cast(event_id AS string), '/') END AS gcs_path
FROM {{events}}"""

# --- the ledger: one run per report and day, made of that day's events ------------------
VIEWS["executions"] = f"""
SELECT concat(report_type, '-', replace(cast(run_day AS string), '-', '')) AS execution_id, report_type,
       max(ts) AS execution_ts,
       CASE WHEN min(user_id) % 4 = 0 THEN 'test' ELSE 'prod' END AS environment,
       CASE WHEN count(*) % 2 = 0 THEN 'production' END AS git_ref, 'branch' AS source_mode,
       concat('user_', cast(max(user_id) AS string)) AS triggered_by,
       CASE WHEN count(*) % 7 = 0 THEN 'failed' WHEN count(*) % 7 = 1 THEN 'skipped' ELSE 'success' END AS status,
       cast(floor(max(value)) AS bigint) AS duration_seconds,
       CASE WHEN count(*) % 5 <> 0 THEN concat('gs://bucket/', report_type, '/', cast(run_day AS string), '/') END AS gcs_path
FROM (SELECT {REPORT_TYPE} AS report_type, cast(ts AS date) AS run_day, ts, user_id, value FROM {{events}}) AS e
GROUP BY report_type, run_day"""

VIEWS["evidence"] = f"""
SELECT CASE WHEN l_linestatus = 'O' THEN {run_of('commit_drift', 'l_orderkey')} ELSE {run_of('file_drift', 'l_orderkey')} END AS execution_id,
       date '2024-01-01' + cast(l_orderkey % 31 AS int) AS run_date,
       concat('repo_', cast(l_suppkey % 25 AS string)) AS repo,
       CASE WHEN l_linestatus = 'O' THEN 'commit' ELSE 'content' END AS drift_type,
       {DISCREPANCY} AS discrepancy,
       concat('c', cast(l_orderkey AS string)) AS commit_sha, l_shipdate AS commit_date,
       concat('author_', cast(l_partkey % 60 AS string), CASE WHEN l_linenumber % 2 = 0 THEN ' (External)' ELSE '' END) AS author,
       {PATH} AS file_path,
       CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_linenumber = 4 THEN 'R100' WHEN l_returnflag = 'R' THEN 'M'
            WHEN l_returnflag = 'A' THEN 'A' ELSE 'D' END AS change_type,
       concat('drift in ', l_linestatus) AS problem_statement
FROM {{lineitem}}"""

VIEWS["kpi_counts"] = """
SELECT execution_id, repo, drift_type, discrepancy, count(DISTINCT commit_sha) AS commits, count(DISTINCT file_path) AS files
FROM {evidence} GROUP BY execution_id, repo, drift_type, discrepancy"""

VIEWS["kpis"] = f"""
SELECT execution_id, date '2024-01-01' + (cast(substring(execution_id, length(execution_id) - 1, 2) AS int) - 1) AS run_date, repo,
       {remote('left')} AS left_branch, {remote('right')} AS right_branch, drift_type,
       CASE WHEN drift_type = 'commit' THEN 'cherry_pick_no_merges' ELSE 'merge_base' END AS comparison_mode,
       CASE WHEN repo IN ('repo_0', 'repo_7') OR drift_type = 'content' THEN NULL ELSE commits END AS unique_commits,
       CASE WHEN repo IN ('repo_0', 'repo_7') THEN NULL ELSE files END AS unique_files,
       CASE WHEN repo IN ('repo_0', 'repo_7') THEN 'N/A'
            WHEN drift_type = 'commit' THEN CASE WHEN commits = 0 THEN 'none' WHEN commits <= 5 THEN 'low' WHEN commits <= 20 THEN 'medium' ELSE 'high' END
            ELSE CASE WHEN files = 0 THEN 'none' WHEN files <= 10 THEN 'low' WHEN files <= 50 THEN 'medium' ELSE 'high' END END AS severity,
       CASE WHEN repo IN ('repo_0', 'repo_7') THEN 'missing_branch' ELSE 'ok' END AS status
FROM {{kpi_counts}}"""

VIEWS["findings"] = f"""
SELECT {run_of('env_drift', 'p_partkey')} AS execution_id, p_brand AS product,
       CASE WHEN p_size % 2 = 0 THEN 'bigquery' ELSE 'gcs' END AS component_type, p_type AS object_type,
       concat('obj_', cast(p_partkey % 500 AS string)) AS object_name,
       CASE p_partkey % 4 WHEN 0 THEN 'only_in_source' WHEN 1 THEN 'only_in_bq' WHEN 2 THEN 'content_mismatch' ELSE 'schema_mismatch' END AS drift_category,
       CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '' ELSE md5(p_name) END AS source_hash,
       CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN '' ELSE md5(p_type) END AS env_hash,
       CASE p_size % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'none' ELSE 'N/A' END AS severity
FROM {{part}}"""

VIEWS["orphans"] = f"""
SELECT {run_of('orphan_datasets', 'c_custkey')} AS execution_id, concat('ds_', cast(c_custkey AS string)) AS dataset_name,
       concat('proj_', cast(c_nationkey AS string)) AS project_id,
       CASE WHEN c_custkey % 4 = 0 THEN 'suspect' ELSE 'orphan' END AS orphan_status,
       c_custkey % 6 = 0 AS source_reference_found,
       CASE WHEN c_custkey % 3 <> 0 THEN timestamp '2024-01-01 00:00:00' END AS last_modified,
       cast(c_custkey % 9 AS bigint) AS table_count, CASE WHEN c_custkey % 8 <> 0 THEN c_mktsegment END AS owner,
       cast(c_custkey % 101 AS bigint) AS risk_score
FROM {{customer}}"""

VIEWS["orphan_objects"] = f"""
SELECT {run_of('orphan_datasets', 'o_custkey')} AS execution_id, concat('ds_', cast(o_custkey AS string)) AS dataset_name,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'base_table' WHEN o_orderstatus = 'O' THEN 'view' ELSE 'procedure' END AS object_type,
       concat('t_', cast(o_orderkey % 300 AS string)) AS object_name, o_orderdate AS last_modified,
       cast(o_orderkey % 1000 AS bigint) AS row_count, cast(o_totalprice AS decimal(18,4)) AS storage_mb
FROM {{orders}}"""

# --- report rows -----------------------------------------------------------------------
VIEWS["details"] = """
SELECT repo, discrepancy, commit_sha AS "commit", commit_date AS created_at, author, file_path, seq,
       CASE order_group WHEN 0 THEN 'Revert x' WHEN 1 THEN 'minor: y' WHEN 2 THEN 'Merge branch z' WHEN 3 THEN 'CHERRY-PICK q' ELSE 'other' END AS message,
       flag
FROM {detail_rows}""".replace('"commit"', "`commit`")

VIEWS["detail_rows"] = f"""
SELECT concat('repo_', cast(l_suppkey % 25 AS string)) AS repo, {DISCREPANCY} AS discrepancy,
       concat('c', cast(l_orderkey AS string)) AS commit_sha, l_shipdate AS commit_date,
       concat('author_', cast(l_partkey % 60 AS string), CASE WHEN l_linenumber % 2 = 0 THEN ' (External)' ELSE '' END) AS author,
       {PATH} AS file_path, l_orderkey % 5 AS order_group, l_returnflag AS flag,
       concat(lpad(cast(l_linenumber AS string), 4, '0'), '-', lpad(cast(l_suppkey AS string), 9, '0'), '-', cast(l_extendedprice AS string), '-', cast(l_shipdate AS string)) AS seq
FROM {{lineitem}}"""

VIEWS["totals"] = """
SELECT repo, discrepancy, CASE WHEN repo IN ('repo_0', 'repo_7') THEN 'N/A' ELSE cast(files AS string) END AS unique_files_affected,
       CASE WHEN repo IN ('repo_0', 'repo_7') THEN 'N/A' ELSE cast(commits AS string) END AS unique_commits,
       CASE WHEN repo IN ('repo_0', 'repo_7') AND discrepancy LIKE '%test%' THEN 'missing_branch' ELSE 'ok' END AS status
FROM (SELECT repo, discrepancy, count(DISTINCT file_path) AS files, count(DISTINCT commit_sha) AS commits
      FROM {detail_rows} GROUP BY repo, discrepancy) AS t"""

# --- commit history --------------------------------------------------------------------
ORDERED = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
SHA = "concat('c', cast(o_orderkey AS string))"
VIEWS["repos"] = "SELECT concat('r', cast(c_custkey AS string)) AS repo FROM {customer}"
VIEWS["commits"] = f"""
SELECT concat('r', cast(o_custkey AS string)) AS repo, {SHA} AS sha,
       md5(concat(cast(o_custkey AS string), '-', cast(o_orderkey % 4 AS string))) AS patch_id,
       o_orderpriority = '5-LOW' AS is_merge, concat('author_', cast(o_custkey % 60 AS string)) AS author,
       concat('a', cast(o_custkey % 60 AS string), '@x') AS author_email, o_orderdate AS authored_at,
       concat('commit | ', o_orderpriority) AS message
FROM {{orders}}"""
VIEWS["history"] = f"""
SELECT concat('r', cast(o_custkey AS string)) AS repo, {SHA} AS sha,
       CASE WHEN o_orderkey % 3 = 0 THEN lag({SHA}, 2) {ORDERED} ELSE lag({SHA}, 1) {ORDERED} END AS first_parent,
       CASE WHEN o_orderpriority = '5-LOW' THEN lag({SHA}, 3) {ORDERED} END AS second_parent,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS age, o_orderstatus AS mark
FROM {{orders}}"""
VIEWS["commit_parents"] = """
SELECT repo, sha, first_parent AS parent_sha, 0 AS parent_index FROM {history}
UNION ALL
SELECT repo, sha, second_parent AS parent_sha, 1 AS parent_index FROM {history} WHERE second_parent IS NOT NULL"""
VIEWS["tips"] = """
SELECT repo, CASE age WHEN 1 THEN 'master' WHEN 2 THEN 'test' ELSE 'production' END AS branch, sha
FROM {history} WHERE age <= 3 AND NOT (age = 2 AND mark = 'P')"""
# Records of clones that were cut off: repositories of one segment lack all commits of urgent orders.
VIEWS["cut_commits"] = f"""
SELECT concat('r', cast(o_custkey AS string)) AS repo, {SHA} AS sha,
       md5(concat(cast(o_custkey AS string), '-', cast(o_orderkey % 4 AS string))) AS patch_id, o_orderpriority = '5-LOW' AS is_merge
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey WHERE NOT (c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT')"""
VIEWS["commit_files"] = f"""
SELECT concat('r', cast(o_custkey AS string)) AS repo, concat('c', cast(l_orderkey AS string)) AS sha, {PATH} AS path,
       CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'R' THEN 'M' ELSE 'D' END AS change_code,
       md5(cast(l_linenumber AS string)) AS diff_hash
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey"""

# --- branch contents -------------------------------------------------------------------
DOC = "concat('models/d', cast(doc_id AS string), '.sql')"
VIEWS["branch_hashes"] = f"""
SELECT source AS repo, {DOC} AS path,
       CASE WHEN doc_id % 23 = 0 THEN concat('models/moved_', cast(doc_id AS string), '.sql') ELSE {DOC} END AS production_path,
       CASE WHEN doc_id % 7 <> 0 THEN md5(text) END AS master_hash,
       CASE WHEN doc_id % 11 <> 0 THEN md5(CASE WHEN doc_id % 5 = 0 THEN lower(text) ELSE text END) END AS test_hash,
       CASE WHEN doc_id % 13 <> 0 THEN md5(CASE WHEN doc_id % 6 = 0 THEN concat(text, '!') ELSE text END) END AS production_hash,
       CASE WHEN doc_id % 17 <> 0 THEN md5(text) END AS base_hash
FROM {{documents}}"""
VIEWS["branch_files"] = """
SELECT * FROM (
  SELECT repo, 'master' AS branch, path, master_hash AS blob_hash FROM {branch_hashes}
  UNION ALL SELECT repo, 'test' AS branch, path, test_hash AS blob_hash FROM {branch_hashes}
  UNION ALL SELECT repo, 'production' AS branch, production_path AS path, production_hash AS blob_hash FROM {branch_hashes}
) AS b WHERE blob_hash IS NOT NULL"""
VIEWS["base_files"] = """
SELECT * FROM (
  SELECT repo, 'master' AS left_name, 'test' AS right_name, path, base_hash AS blob_hash FROM {branch_hashes}
  UNION ALL SELECT repo, 'master' AS left_name, 'production' AS right_name, path, base_hash AS blob_hash FROM {branch_hashes}
  UNION ALL SELECT repo, 'production' AS left_name, 'test' AS right_name, path, master_hash AS blob_hash FROM {branch_hashes}
) AS b WHERE blob_hash IS NOT NULL AND repo <> 'src3'"""
VIEWS["bases"] = "SELECT DISTINCT repo, left_name, right_name FROM {base_files}"
VIEWS["doc_repos"] = "SELECT DISTINCT source AS repo FROM {documents}"
VIEWS["doc_tips"] = "SELECT DISTINCT repo, branch, repo AS sha FROM {branch_files} WHERE NOT (repo = 'src1' AND branch = 'test')"
VIEWS["doc_meta"] = """
SELECT repo, branch, path, concat('c', blob_hash) AS created_commit, '2024-01-01' AS created_at, 'author_a' AS created_author,
       'a@x' AS created_author_email, 'add' AS created_message, concat('l', blob_hash) AS last_change_commit,
       '2024-02-01' AS last_change_at, 'author_b' AS last_change_author, 'b@x' AS last_change_author_email, branch AS last_change_message
FROM {branch_files}"""

# --- branch contents whose files moved and changed ---------------------------------------
DROPPED = "regexp_replace(text, '^[^\n]*\n', '')"  # without the first line
VIEWS["edited_files"] = f"""
SELECT * FROM (
  SELECT source AS repo, 'master' AS branch, {DOC} AS path, text FROM {{documents}} WHERE doc_id % 9 <> 0
  UNION ALL
  SELECT source AS repo, 'test' AS branch, CASE WHEN doc_id % 3 = 0 THEN concat('moved/t', cast(doc_id AS string), '.sql') ELSE {DOC} END AS path,
         CASE doc_id % 4 WHEN 0 THEN concat(text, chr(10), 'select ', source) WHEN 1 THEN {DROPPED} WHEN 2 THEN concat(source, chr(10), {DROPPED}) ELSE text END AS text
  FROM {{documents}} WHERE doc_id % 13 <> 0
  UNION ALL
  SELECT source AS repo, 'production' AS branch, CASE WHEN doc_id % 5 = 0 THEN concat('moved/p', cast(doc_id AS string), '.sql') ELSE {DOC} END AS path,
         CASE doc_id % 6 WHEN 0 THEN {DROPPED} WHEN 1 THEN concat(text, chr(10), text) WHEN 2 THEN replace(text, chr(10), concat(chr(13), chr(10))) ELSE text END AS text
  FROM {{documents}} WHERE doc_id % 17 <> 0
) AS f WHERE text IS NOT NULL"""
VIEWS["edited_hashes"] = "SELECT repo, branch, path, md5(text) AS blob_hash FROM {edited_files}"
VIEWS["edited_blobs"] = "SELECT DISTINCT repo, md5(text) AS blob, text FROM {edited_files}"

# --- commits with the contents of their files: the same change at other lines, and changes of several files
HEAD = "concat(" + ", ".join(["'-- head', chr(10)"] * 9) + ", text)"
VIEWS["content_changes"] = f"""
SELECT source AS repo, concat('a', cast(doc_id AS string)) AS sha, {DOC} AS path, text AS old_text, concat(text, chr(10), 'select  ', cast(doc_id AS string)) AS new_text FROM {{documents}}
UNION ALL
SELECT source AS repo, concat('b', cast(doc_id AS string)) AS sha, {DOC} AS path, {HEAD} AS old_text, concat({HEAD}, chr(10), 'select ', cast(doc_id AS string)) AS new_text FROM {{documents}}
UNION ALL
SELECT source AS repo, concat('c', cast(doc_id % 10 AS string)) AS sha, {DOC} AS path, CASE WHEN doc_id % 7 <> 0 THEN text END AS old_text,
       CASE WHEN doc_id % 7 <> 0 THEN concat('-- new ', cast(doc_id AS string), chr(10), text) ELSE text END AS new_text
FROM {{documents}}"""
VIEWS["content_commits"] = "SELECT repo, sha, path, md5(old_text) AS old_blob, md5(new_text) AS new_blob FROM {content_changes}"
VIEWS["content_blobs"] = """
SELECT repo, md5(old_text) AS blob, old_text AS text FROM {content_changes} WHERE old_text IS NOT NULL
UNION
SELECT repo, md5(new_text) AS blob, new_text AS text FROM {content_changes} WHERE new_text IS NOT NULL"""

# --- files and catalog -----------------------------------------------------------------
FILE = (
    "CASE WHEN doc_id % 2 = 0 THEN concat('dbt/models/d', cast(doc_id AS string), '.sql') WHEN doc_id % 3 = 0"
    " THEN concat('python/jobs/d', cast(doc_id AS string), '.bin') ELSE concat('python/jobs/d', cast(doc_id AS string), '.py') END"
)
CRLF = "replace(text, chr(10), concat(chr(13), chr(10)))"
VIEWS["doc_files"] = f"""
SELECT source AS product, {FILE} AS path, CASE WHEN doc_id % 7 <> 0 THEN text END AS source_text,
       CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN concat(text, '!') WHEN doc_id % 4 <> 1 THEN {CRLF} ELSE text END AS deployed_text,
       CASE WHEN doc_id % 9 = 0 THEN concat(split_part({FILE}, '/', 1), '/', {FILE}) ELSE {FILE} END AS deployed_path
FROM {{documents}}"""
VIEWS["source_texts"] = "SELECT product, path, source_text AS text FROM {doc_files} WHERE source_text IS NOT NULL"
VIEWS["deployed_texts"] = "SELECT product, deployed_path AS path, deployed_text AS text FROM {doc_files} WHERE deployed_text IS NOT NULL"

DS = "concat('ds_', replace(p_brand, '#', '_'))"
OBJ = "concat('t_', cast(p_partkey AS string))"
VIEWS["ddl_sources"] = f"""
SELECT p_brand AS product, concat('bq/', {OBJ}, '.sql') AS path, {DS} AS dataset, {OBJ} AS object_name, p_size % 5 AS variant, p_partkey,
       CASE p_size % 5
         WHEN 0 THEN concat('-- table', chr(10), 'CREATE OR REPLACE TABLE `proj.', {DS}, '.', {OBJ}, '` (', chr(10), '  id INT64,', chr(10), '  v STRING NOT NULL,', chr(10), '  -- money', chr(10), '  amount NUMERIC(10, 2),', chr(10), '  tags ARRAY<STRUCT<k STRING, n INT64>>', chr(10), ') OPTIONS(x=1);')
         WHEN 1 THEN concat('alter table `', {DS}, '.', {OBJ}, '` ADD COLUMN IF NOT EXISTS a INT64, ADD COLUMN b STRING;')
         WHEN 2 THEN concat('CREATE VIEW IF NOT EXISTS proj.', {DS}, '.', {OBJ}, ' AS', chr(10), 'SELECT id, ''', p_name, ''' AS n -- note', chr(10), 'FROM `proj.', {DS}, '.base`;')
         WHEN 3 THEN concat('create or replace  procedure `', {DS}, '.', {OBJ}, '`(x INT64)', chr(10), 'BEGIN SELECT 1; END;')
         ELSE concat('INSERT INTO x SELECT ', cast(p_partkey AS string)) END AS text
FROM {{part}}"""
VIEWS["ddl_texts"] = """
SELECT product, path, text FROM {ddl_sources}
UNION ALL
SELECT product, concat('bq/', object_name, '_more.sql') AS path,
       concat('ALTER TABLE `proj.', dataset, '.', object_name, '` ADD COLUMN extra FLOAT64, add column v BYTES') AS text
FROM {ddl_sources} WHERE variant = 0"""
VIEWS["catalog_tables"] = f"""
SELECT p_brand AS product, 'proj' AS project, {DS} AS dataset, CASE WHEN p_partkey % 13 = 0 THEN concat('x_', cast(p_partkey AS string)) ELSE {OBJ} END AS object_name,
       CASE WHEN p_partkey % 17 = 0 THEN 'MATERIALIZED VIEW' WHEN p_size % 5 = 2 THEN 'VIEW' ELSE 'BASE TABLE' END AS object_type,
       concat('CREATE TABLE ', {OBJ}) AS ddl, p_size % 5 AS variant, p_partkey, p_name
FROM {{part}}"""
VIEWS["catalog_routines"] = """
SELECT product, 'proj' AS project, dataset, object_name, 'PROCEDURE' AS object_type, concat('BEGIN SELECT ', cast(p_partkey AS string), '; END') AS routine_definition
FROM {ddl_sources} WHERE variant = 3"""
VIEWS["catalog_views"] = """
SELECT product, project, dataset, object_name,
       concat('SELECT id, ''', p_name, ''' AS n', chr(10), '   FROM `', dataset, '.', CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE 'base' END, '`') AS view_definition
FROM {catalog_tables} WHERE variant = 2"""
VIEWS["catalog_columns"] = """
SELECT product, project, dataset, object_name, column_name,
       CASE WHEN column_name = 'v' AND p_partkey % 6 = 0 THEN 'string' WHEN column_name = 'v' THEN 'BYTES' WHEN column_name = 'amount' THEN 'NUMERIC(10,2)'
            WHEN column_name = 'extra' THEN 'FLOAT64' WHEN column_name = 'tags' THEN 'ARRAY<STRUCT<k STRING, n INT64>>' ELSE 'INT64' END AS data_type
FROM (
  SELECT product, project, dataset, object_name, p_partkey, 'id' AS column_name FROM {catalog_tables}
  UNION ALL SELECT product, project, dataset, object_name, p_partkey, 'v' AS column_name FROM {catalog_tables}
  UNION ALL SELECT product, project, dataset, object_name, p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'w' ELSE 'amount' END AS column_name FROM {catalog_tables}
  UNION ALL SELECT product, project, dataset, object_name, p_partkey, 'extra' AS column_name FROM {catalog_tables}
  UNION ALL SELECT product, project, dataset, object_name, p_partkey, 'tags' AS column_name FROM {catalog_tables}
) AS c"""
VIEWS["model_texts"] = """
SELECT source AS product,
       CASE WHEN doc_id % 8 = 0 THEN concat('dbt/target/models/m', cast(doc_id AS string), '.sql')
            WHEN doc_id % 9 = 0 THEN concat('dbt/models/late/m', cast(doc_id - 1 AS string), '.sql')
            ELSE concat('dbt/models/m', cast(doc_id AS string), '.sql') END AS path,
       concat(CASE doc_id % 3 WHEN 0 THEN '{{ config(tags=[1], materialized = "Ephemeral ") }}' WHEN 1 THEN concat('{{config(', chr(10), 'materialized=''view'')}}') ELSE '' END, chr(10), text) AS text
FROM {documents}""".replace("{{", "{{{{").replace("}}", "}}}}")
VIEWS["dag_texts"] = """
SELECT source AS product, concat('python/dags/d', cast(doc_id AS string), '.py') AS path, doc_id, lang,
       concat(text, chr(10), CASE WHEN doc_id % 4 <> 0 THEN concat('with DAG(dag_id = ''dag_', lang, '_', cast(doc_id AS string), ''') as d:', chr(10)) ELSE '' END,
              CASE WHEN doc_id % 3 = 0 THEN concat('globals()["gen_', lang, '"] = d') ELSE '' END) AS text
FROM {documents}"""
VIEWS["ci_texts"] = """
SELECT concat('repo_', cast(c_custkey AS string)) AS repo, 'origin/production' AS git_ref, c_custkey,
       concat('stages:', chr(10), '  - deploy', chr(10), 'variables:', chr(10), '  BQ_PROJECT: "proj_', cast(c_nationkey AS string), '"', chr(10),
              '  BQ_DATASET_NAMES: "ds_', cast(c_custkey * 3 AS string), ', ds_', cast(c_custkey * 3 + 1 AS string), ',"', chr(10), '  plain text', chr(10),
              'deploy_to_prod_bq:', chr(10), '  stage: deploy', chr(10), '  variables:', chr(10), '    ENV: prod', chr(10),
              CASE WHEN c_custkey % 3 = 0 THEN concat('    BQ_DATASET_NAMES: ''ds_', cast(c_custkey * 3 AS string), '''', chr(10)) ELSE '' END,
              '  script:', chr(10), '    - run: it', chr(10), 'deploy_to_prod_python:', chr(10), '  variables:', chr(10),
              CASE WHEN c_custkey % 5 = 0 THEN concat('    GCP_BUCKET: b_', c_mktsegment, chr(10)) ELSE '' END, '  script: x', chr(10)) AS text
FROM {customer}"""
VIEWS["catalog_datasets"] = """
SELECT concat(CASE WHEN c_custkey % 10 = 0 THEN '_' ELSE '' END, 'ds_', cast(c_custkey AS string)) AS dataset, concat('proj_', cast(c_nationkey AS string)) AS project_id,
       CASE WHEN c_custkey % 19 = 0 THEN 'tables: denied' END AS table_error, CASE WHEN c_custkey % 38 = 0 THEN 'routines: denied' END AS routine_error
FROM {customer}"""
VIEWS["dataset_objects"] = """
SELECT concat('ds_', cast(o_custkey AS string)) AS dataset, concat('t_', cast(o_orderkey AS string)) AS object_name,
       CASE o_orderstatus WHEN 'F' THEN 'base_table' WHEN 'O' THEN 'view' ELSE 'procedure' END AS object_type
FROM {orders}"""
# The same datasets and objects as a catalog shows them that knows owners, times and sizes.
VIEWS["owned_datasets"] = """
SELECT concat(CASE WHEN c_custkey % 10 = 0 THEN '_' ELSE '' END, 'ds_', cast(c_custkey AS string)) AS dataset, concat('proj_', cast(c_nationkey AS string)) AS project_id,
       CASE WHEN c_custkey % 19 = 0 THEN 'tables: denied' END AS error, CASE WHEN c_custkey % 4 <> 0 THEN concat('team_', c_mktsegment) END AS owner, last_modified
FROM {customer} LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_modified FROM {orders} GROUP BY o_custkey) AS o ON o_custkey = c_custkey"""
VIEWS["sized_objects"] = """
SELECT concat('ds_', cast(o_custkey AS string)) AS dataset, concat('t_', cast(o_orderkey AS string)) AS object_name,
       CASE o_orderstatus WHEN 'F' THEN 'base_table' WHEN 'O' THEN 'view' ELSE 'procedure' END AS object_type,
       o_orderdate AS last_modified, cast(o_orderkey % 1000 AS bigint) AS row_count, o_totalprice AS storage_mb
FROM {orders}"""
VIEWS["scan_targets"] = """
SELECT DISTINCT p_brand AS product, 'proj' AS project, 'prod' AS environment, 'bucket' AS bucket, CASE WHEN p_brand LIKE '%1' THEN '' ELSE concat('ds_', p_brand) END AS datasets
FROM {part}"""
LOG_HEAD = "concat('@@@c', cast(o_orderkey AS string), '|', cast(cast(o_orderdate AS date) AS string), '|author_', cast(o_custkey % 60 AS string), '|a@x|commit | ', o_orderpriority)"
VIEWS["log_texts"] = f"""
SELECT concat('r', cast(o_custkey AS string)) AS repo, o_orderstatus AS discrepancy, o_orderkey,
       concat('lost/', cast(o_orderkey AS string), chr(10), {LOG_HEAD}, chr(10), 'dir/a_', cast(o_orderkey AS string), '.sql', chr(13), chr(10), chr(10), ' dir/b.sql ', chr(10),
              '@@@broken|', o_orderpriority, chr(10), 'dir/c.sql', chr(10), {LOG_HEAD}, '!', chr(10), 'dir/d.sql') AS text
FROM {{orders}}"""
VIEWS["sql_texts"] = """
SELECT doc_id, source, concat('SELECT `a`.B  -- ', lang, chr(13), chr(10), text, chr(9), '/* x', chr(10), 'y */', ' FROM `proj.', source, '.T` JOIN proj.', source, '.U') AS text
FROM {documents}"""

NAME = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def plain(sql: str) -> str:
    """The text as the checking engine reads it: names without braces, double-quoted keywords."""
    return NAME.sub(r"\1", sql).replace("{{{{", "{{").replace("}}}}", "}}").replace("`commit`", '"commit"')


def _needed(sql: str, extra: dict[str, str], found: list[str]) -> None:
    for name in NAME.findall(sql):
        text = extra.get(name) or VIEWS.get(name)
        if text is not None and name not in found:
            _needed(text, extra, found)
            if name not in found:
                found.append(name)


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` preceded by the views it names, as common table expressions."""
    extra = extra or {}
    names: list[str] = []
    _needed(sql, extra, names)
    parts = [f"{n} AS ({plain(extra.get(n) or VIEWS[n])})" for n in names]
    body = plain(sql).strip()
    recursive = re.match(r"(?is)WITH\s+RECURSIVE\s+", body)
    if recursive:
        return "WITH RECURSIVE " + ", ".join([*parts, body[recursive.end() :]])
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join([*parts, body[5:]])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


class Views:
    """Given tables and derived views as DataFrames: ``Views(spark, folder).executions``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # ledger times are UTC

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            if name in TABLES:
                frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                used = {n: getattr(self, n) for n in dict.fromkeys(NAME.findall(VIEWS[name]))}
                frame = self.spark.sql(VIEWS[name], **used)
            self._frames[name] = frame
        return self._frames[name]
