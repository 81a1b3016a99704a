"""Branch drift, commit history and report comparisons."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings.registry import CHECK_VIEWS, query
from plumbline.constants import DIFFERENCE_COLUMNS, DIFFERENCE_TYPES, DIRECT, DIRECTIONS, MATRIX_ORDER, MERGE_BASE
from plumbline.operators import ancestry, branches, executive, history, reconcile, similarity, trees
from plumbline.session import cut_lineage, scratch_path
from plumbline.sources import snapshots

V = CHECK_VIEWS
AS_OF = datetime(2002, 1, 1)
SPLIT_AT = datetime(2000, 1, 1)  # commits before it are stored first

PAIRS = "(VALUES " + ", ".join(f"('{n}', '{l}', '{r}')" for n, l, r in DIRECTIONS) + ") AS p(discrepancy, left_name, right_name)"


# --- two versions of a report ----------------------------------------------------------
V["report_old"] = "SELECT * FROM {details} WHERE flag <> 'R'"
V["report_new"] = "SELECT * FROM {details} WHERE flag <> 'A'"
RKEY = 'repo, discrepancy, "commit", file_path'


def old_new(v):
    return v.details.where("flag <> 'R'"), v.details.where("flag <> 'A'")


def one_sided(side: str, other: str) -> str:
    return f"""
SELECT 'only_in_{side}' AS side, {RKEY}, created_at, author, message, flag FROM {{report_{side}}} r
WHERE NOT EXISTS (SELECT 1 FROM {{report_{other}}} x WHERE x.repo = r.repo AND x.discrepancy = r.discrepancy AND x."commit" = r."commit" AND x.file_path = r.file_path)
QUALIFY row_number() OVER (PARTITION BY {RKEY} ORDER BY seq DESC) = 1"""


@query("report_diff", f"{one_sided('old', 'new')} UNION ALL {one_sided('new', 'old')}")
def _(v):
    return reconcile.report_diff(*old_new(v), order="seq")


@query("snapshot_diff", f"{one_sided('old', 'new')} UNION ALL {one_sided('new', 'old')}")
def _(v):
    names = []
    for report in old_new(v):
        path = scratch_path(v.spark, "snapshot")
        names.append(f"snapshot_{path[-32:]}")
        snapshots.store_snapshot(report, names[-1], path, reconcile.REPORT_KEY, "seq", buckets=16)
    return snapshots.compare_snapshots(v.spark, *names)


V["pair_delta"] = """
SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.discrepancy, n.discrepancy) AS discrepancy, coalesce(o.c, 0) AS count_old, coalesce(n.c, 0) AS count_new,
       coalesce(n.c, 0) - coalesce(o.c, 0) AS delta
FROM (SELECT repo, discrepancy, count(*) AS c FROM {report_old} GROUP BY ALL) o
FULL JOIN (SELECT repo, discrepancy, count(*) AS c FROM {report_new} GROUP BY ALL) n ON o.repo = n.repo AND o.discrepancy = n.discrepancy
WHERE coalesce(n.c, 0) <> coalesce(o.c, 0)"""


@query("pair_delta", "SELECT * FROM {pair_delta}")
def _(v):
    return reconcile.pair_delta(*old_new(v))


@query("diff_summary", f"""
SELECT (SELECT count(*) FROM {{report_old}}) AS rows_old, (SELECT count(*) FROM {{report_new}}) AS rows_new,
       (SELECT count(*) FROM {{report_new}}) - (SELECT count(*) FROM {{report_old}}) AS delta_rows,
       (SELECT count(*) FROM ({one_sided('old', 'new')})) AS only_in_old, (SELECT count(*) FROM ({one_sided('new', 'old')})) AS only_in_new,
       (SELECT count(*) FROM {{pair_delta}}) AS changed_repo_discrepancy_pairs""")
def _(v):
    return reconcile.diff_summary(*old_new(v))


@query("key_sets", """
SELECT 'union' AS op, repo, "commit" FROM (SELECT repo, "commit" FROM {report_old} UNION SELECT repo, "commit" FROM {report_new})
UNION ALL SELECT 'except' AS op, repo, "commit" FROM (SELECT repo, "commit" FROM {report_old} EXCEPT SELECT repo, "commit" FROM {report_new})
UNION ALL SELECT 'intersect' AS op, repo, "commit" FROM (SELECT repo, "commit" FROM {report_old} INTERSECT SELECT repo, "commit" FROM {report_new})""")
def _(v):
    old, new = old_new(v)
    ops = {"union": reconcile.keys_union, "except": reconcile.keys_except, "intersect": reconcile.keys_intersect}
    frames = [f(old, new, ["repo", "commit"]).select(F.lit(n).alias("op"), "repo", "commit") for n, f in ops.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("sorted_distinct", "SELECT DISTINCT file_path FROM {details}")
def _(v):
    return reconcile.sorted_distinct(v.details, "file_path")


# --- ancestry --------------------------------------------------------------------------
V["closure"] = """
SELECT * FROM (WITH RECURSIVE walk AS (
  SELECT repo, branch, sha FROM {tips}
  UNION SELECT w.repo, w.branch, p.parent_sha AS sha FROM walk w JOIN {commit_parents} p ON p.repo = w.repo AND p.sha = w.sha WHERE p.parent_sha IS NOT NULL
) SELECT * FROM walk)"""


def closure(v):
    return history.reachable(v.commit_parents, v.tips)


@query("reachable", "SELECT repo, branch, sha FROM {closure}")
def _(v):
    return closure(v)


@query("reachable_stored", "SELECT repo, branch, sha FROM {closure}")
def _(v):
    """An index of the commits before a day, with each repository's newest of them as a tip, extended by all later commits."""
    base = scratch_path(v.spark, "ancestry")
    parents, tips = cut_lineage(v.commit_parents, "parents"), cut_lineage(v.tips, "tips")
    old = v.commits.where(F.col("authored_at") < F.lit(SPLIT_AT).cast("timestamp")).select("repo", "sha", "authored_at")
    newest = old.groupBy("repo").agg(F.max_by("sha", F.struct("authored_at", "sha")).alias("sha"))
    ancestry.extend_index(base, parents.join(old, ["repo", "sha"], "left_semi"), newest)
    ancestry.extend_index(base, parents, tips)
    return ancestry.reachable_from_index(v.spark, base, tips)


V["common"] = """
SELECT a.repo, a.branch AS left_name, b.branch AS right_name, a.sha FROM {closure} a JOIN {closure} b ON a.repo = b.repo AND a.sha = b.sha
WHERE (a.branch, b.branch) IN (('master', 'test'), ('master', 'production'), ('test', 'production'))"""


@query("merge_bases", """
SELECT repo, left_name, right_name, min(sha) AS base_sha FROM {common} c
WHERE NOT EXISTS (SELECT 1 FROM {common} d JOIN {commit_parents} p ON p.repo = d.repo AND p.sha = d.sha
                  WHERE d.repo = c.repo AND d.left_name = c.left_name AND d.right_name = c.right_name AND p.parent_sha = c.sha)
GROUP BY repo, left_name, right_name""")
def _(v):
    return history.merge_bases(closure(v), v.commit_parents)


V["gap_flags"] = "SELECT repo, sha, bool_or(branch = 'master') AS s, bool_or(branch = 'production') AS t FROM {closure} WHERE branch IN ('master', 'production') GROUP BY ALL"
V["ahead"] = """
SELECT repo, count(*) FILTER (WHERE s AND NOT t) AS source_commits_not_in_target, count(*) FILTER (WHERE t AND NOT s) AS target_commits_not_in_source
FROM {gap_flags} GROUP BY repo"""
V["waiting"] = """
SELECT f.repo, min(c.authored_at) AS oldest_waiting, max(c.authored_at) AS newest_waiting,
       cast(floor((epoch(timestamp '2002-01-01 00:00:00') - epoch(min(c.authored_at))) / 86400) AS bigint) AS waiting_days
FROM {gap_flags} f JOIN {commits} c ON c.repo = f.repo AND c.sha = f.sha WHERE f.s AND NOT f.t GROUP BY f.repo"""
V["last_commits"] = "SELECT t.repo, t.branch, t.sha AS last_commit, c.authored_at AS last_commit_date FROM {tips} t JOIN {commits} c ON c.repo = t.repo AND c.sha = t.sha"


@query("ahead_behind", "SELECT * FROM {ahead}")
def _(v):
    return history.ahead_behind(closure(v), "master", "production")


@query("waiting_days", "SELECT * FROM {waiting}")
def _(v):
    return history.waiting(closure(v), v.commits, "master", "production", AS_OF)


@query("last_commits", "SELECT * FROM {last_commits}")
def _(v):
    return history.last_commits(v.tips, v.commits)


@query("branch_gap", """
SELECT r.repo, 'master' AS source_branch, 'production' AS target_branch,
       CASE WHEN s.repo IS NULL THEN 'unknown' WHEN t.repo IS NULL THEN 'missing' ELSE 'yes' END AS target_branch_present,
       CASE WHEN t.repo IS NOT NULL AND s.repo IS NOT NULL THEN a.source_commits_not_in_target END AS source_commits_not_in_target,
       CASE WHEN t.repo IS NOT NULL AND s.repo IS NOT NULL THEN a.target_commits_not_in_source END AS target_commits_not_in_source,
       CASE WHEN t.repo IS NOT NULL AND s.repo IS NOT NULL THEN w.oldest_waiting END AS oldest_source_commit_not_in_target,
       CASE WHEN t.repo IS NOT NULL AND s.repo IS NOT NULL THEN coalesce(w.waiting_days, 0) END AS waiting_days,
       CASE WHEN s.repo IS NOT NULL THEN t.last_commit END AS last_target_commit, CASE WHEN s.repo IS NOT NULL THEN t.last_commit_date END AS last_target_commit_date,
       s.last_commit AS last_source_commit, s.last_commit_date AS last_source_commit_date,
       CASE WHEN s.repo IS NULL THEN 'no origin/master' WHEN t.repo IS NULL THEN 'no origin/production'
            WHEN a.source_commits_not_in_target = 0 THEN 'in sync' ELSE 'waiting for sync' END AS status
FROM {repos} r LEFT JOIN (SELECT * FROM {last_commits} WHERE branch = 'master') s ON s.repo = r.repo
LEFT JOIN (SELECT * FROM {last_commits} WHERE branch = 'production') t ON t.repo = r.repo
LEFT JOIN {ahead} a ON a.repo = r.repo LEFT JOIN {waiting} w ON w.repo = r.repo""")
def _(v):
    return history.branch_gap(v.repos, v.tips, closure(v), v.commits, "master", "production", AS_OF)


TOUCH = "SELECT b.repo, b.branch, f.path, f.change_code, c.* EXCLUDE (repo) FROM {closure} b JOIN {commit_files} f ON f.repo = b.repo AND f.sha = b.sha JOIN {commits} c ON c.repo = b.repo AND c.sha = b.sha"
V["touch"] = TOUCH


def last_of(rows: str, prefix: str) -> str:
    return f"""(SELECT repo, branch, path, sha AS {prefix}_commit, authored_at AS {prefix}_at, author AS {prefix}_author, author_email AS {prefix}_author_email, message AS {prefix}_message
FROM {rows} QUALIFY row_number() OVER (PARTITION BY repo, branch, path ORDER BY authored_at DESC, sha DESC) = 1)"""


@query("file_meta", f"""
SELECT l.repo, l.branch, l.path, c.created_commit, c.created_at, c.created_author, c.created_author_email, c.created_message,
       l.last_change_commit, l.last_change_at, l.last_change_author, l.last_change_author_email, l.last_change_message, a.sha AS first_added_commit
FROM {last_of('{touch}', 'last_change')} l
LEFT JOIN {last_of("(SELECT * FROM {touch} WHERE change_code = 'A')", 'created')} c ON c.repo = l.repo AND c.branch = l.branch AND c.path = l.path
LEFT JOIN (SELECT repo, branch, path, sha FROM {{touch}} WHERE change_code = 'A'
           QUALIFY row_number() OVER (PARTITION BY repo, branch, path ORDER BY authored_at, sha) = 1) a ON a.repo = l.repo AND a.branch = l.branch AND a.path = l.path""")
def _(v):
    return history.file_meta(closure(v), v.commits, v.commit_files)


WORDS = ", ".join(f"cast(sum(cast('0x' || substring(w, {1 + 8 * i}, 8) AS bigint)) AS bigint) AS w{i}" for i in range(4))


@query("patch_fingerprint", f"""
SELECT repo, sha, md5(concat_ws('-', w0, w1, w2, w3)) AS patch_id
FROM (SELECT repo, sha, {WORDS} FROM (SELECT repo, sha, md5(path || '|' || diff_hash) AS w FROM {{commit_files}}) GROUP BY repo, sha)""")
def _(v):
    return history.patch_fingerprint(v.commit_files)


BLANKS = r"'[\x20\x09\x0B-\x0D]'"
V["content_lines"] = f"""
SELECT *, string_split(regexp_replace(old_text, {BLANKS}, '', 'g'), chr(10)) AS l FROM {{content_changes}} WHERE old_text <> new_text OR old_text IS NULL"""
# Where the changed line stands is known here, so its hunk is put together from its neighbours.
V["content_hunks"] = f"""
SELECT repo, sha, path, sha256('@' || chr(10) || CASE
  WHEN old_text IS NULL THEN array_to_string(list_transform(string_split(regexp_replace(new_text, {BLANKS}, '', 'g'), chr(10)), lambda x: '+' || x || chr(10)), '')
  WHEN sha[1] = 'c' THEN '+--new' || regexp_extract(path, '[0-9]+') || chr(10) || array_to_string(list_transform(l[1:3], lambda x: ' ' || x || chr(10)), '')
  ELSE array_to_string(list_transform(l[-3:], lambda x: ' ' || x || chr(10)), '') || '+select' || sha[2:] || chr(10) END) AS diff_hash
FROM {{content_lines}}"""


@query("content_patch_ids", f"""
SELECT repo, sha, md5(concat_ws('-', w0, w1, w2, w3)) AS patch_id
FROM (SELECT repo, sha, {WORDS} FROM (SELECT repo, sha, md5(path || '|' || diff_hash) AS w FROM {{content_hunks}}) GROUP BY repo, sha)""")
def _(v):
    return history.patch_fingerprint(history.diff_hashes(v.content_commits, v.content_blobs))


# --- commit drift ----------------------------------------------------------------------
V["directed"] = f"""
SELECT r.repo, p.discrepancy, 'origin/' || p.left_name AS left_branch, 'origin/' || p.right_name AS right_branch,
       CASE WHEN EXISTS (SELECT 1 FROM {{tips}} t WHERE t.repo = r.repo AND t.branch = p.left_name)
             AND EXISTS (SELECT 1 FROM {{tips}} t WHERE t.repo = r.repo AND t.branch = p.right_name) THEN 'ok' ELSE 'missing_branch' END AS status
FROM {{repos}} r, {PAIRS}"""
V["sided"] = f"""
SELECT p.discrepancy, c.repo, c.sha, c.patch_id, coalesce(list_contains(b.branches, p.left_name), false) AS in_left,
       coalesce(list_contains(b.branches, p.right_name), false) AS in_right
FROM {{commits}} c LEFT JOIN (SELECT repo, sha, list(DISTINCT branch) AS branches FROM {{closure}} GROUP BY repo, sha) b ON b.repo = c.repo AND b.sha = c.sha, {PAIRS}
WHERE NOT c.is_merge"""
V["unique_commits"] = """
SELECT u.repo, u.discrepancy, u.sha FROM {sided} u
ANTI JOIN (SELECT DISTINCT discrepancy, repo, patch_id FROM {sided} WHERE in_left AND NOT in_right) l
ON l.discrepancy = u.discrepancy AND l.repo = u.repo AND l.patch_id = u.patch_id WHERE u.in_right AND NOT u.in_left"""
V["commit_counts"] = """
SELECT u.repo, u.discrepancy, count(DISTINCT u.sha) AS unique_commits, count(DISTINCT f.path) AS unique_files, count(f.path) AS total_file_lines
FROM {unique_commits} u LEFT JOIN {commit_files} f ON f.repo = u.repo AND f.sha = u.sha GROUP BY ALL"""


def graded(column: str, low: int, medium: int) -> str:
    return f"CASE WHEN {column} IS NULL THEN 'N/A' WHEN {column} = 0 THEN 'none' WHEN {column} <= {low} THEN 'low' WHEN {column} <= {medium} THEN 'medium' ELSE 'high' END"


V["commit_kpis"] = f"""
SELECT *, {graded('unique_commits', 5, 20)} AS severity FROM (
  SELECT d.repo, d.discrepancy, d.left_branch, d.right_branch, 'commit' AS drift_type, 'cherry_pick_no_merges' AS comparison_mode,
         CASE WHEN d.status = 'ok' THEN coalesce(c.unique_commits, 0) END AS unique_commits, CASE WHEN d.status = 'ok' THEN coalesce(c.unique_files, 0) END AS unique_files,
         CASE WHEN d.status = 'ok' THEN coalesce(c.total_file_lines, 0) END AS total_file_lines, d.status
  FROM {{directed}} d LEFT JOIN {{commit_counts}} c ON c.repo = d.repo AND c.discrepancy = d.discrepancy)"""


def directed(v):
    presence = branches.branch_presence(v.repos, v.tips)
    return presence, branches.repo_directions(presence)


def unique_commits(v):
    return branches.patch_unique(v.commits, closure(v))


def commit_kpis(v):
    presence, rows = directed(v)
    return presence, branches.commit_kpis(rows, branches.commit_counts(unique_commits(v), v.commit_files))


@query("repo_directions", "SELECT * FROM {directed}")
def _(v):
    return directed(v)[1]


@query("patch_unique", "SELECT * FROM {unique_commits}")
def _(v):
    return unique_commits(v)


@query("commit_kpis", "SELECT * FROM {commit_kpis}")
def _(v):
    return commit_kpis(v)[1]


V["cut_sides"] = "SELECT DISTINCT c.repo, 'origin/' || c.branch AS side FROM {closure} c ANTI JOIN {cut_commits} k ON k.repo = c.repo AND k.sha = c.sha"
V["cut_directed"] = """
SELECT d.* EXCLUDE (status), CASE WHEN d.status = 'ok' AND EXISTS (SELECT 1 FROM {cut_sides} s WHERE s.repo = d.repo AND s.side IN (d.left_branch, d.right_branch))
       THEN 'error' ELSE d.status END AS status
FROM {directed} d"""


@query("cut_history_status", "SELECT * FROM {cut_directed}")
def _(v):
    return branches.history_status(directed(v)[1], closure(v), v.cut_commits)


V["presence"] = """
SELECT r.repo, coalesce(bool_or(t.branch = 'master'), false) AS has_master, coalesce(bool_or(t.branch = 'test'), false) AS has_test,
       coalesce(bool_or(t.branch = 'production'), false) AS has_production
FROM {repos} r LEFT JOIN {tips} t ON t.repo = r.repo GROUP BY r.repo"""


def matrix_sql(kpis: str, presence: str, measure: str, pattern: str) -> str:
    cells = []
    for name in MATRIX_ORDER:
        right, left = name.split("_not_in_")
        cells.append(f"coalesce(max(cast({measure} AS string)) FILTER (WHERE discrepancy = '{name}' AND status = 'ok'), 'N/A') AS \"{pattern.format(right=right, left=left)}\"")
    return f"SELECT p.*, m.* EXCLUDE (repo) FROM {{{presence}}} p JOIN (SELECT repo, {', '.join(cells)} FROM {{{kpis}}} GROUP BY repo) m ON m.repo = p.repo"


@query("commit_matrix", matrix_sql("commit_kpis", "presence", "unique_commits", "{right}_not_in_{left}_commits_no_merges"))
def _(v):
    presence, kpis = commit_kpis(v)
    return branches.commit_matrix(kpis, presence)


@query("file_matrix_commit", matrix_sql("commit_kpis", "presence", "unique_files", "{right}_files_not_in_{left}_no_merges"))
def _(v):
    presence, kpis = commit_kpis(v)
    return branches.file_matrix_commit(kpis, presence)


@query("totals_commit", """
SELECT repo, discrepancy, left_branch, right_branch, coalesce(cast(total_file_lines AS string), 'N/A') AS total_file_lines,
       coalesce(cast(unique_files AS string), 'N/A') AS unique_files_affected, coalesce(cast(unique_commits AS string), 'N/A') AS unique_commits, status
FROM {commit_kpis}""")
def _(v):
    return branches.totals_commit(commit_kpis(v)[1])


@query("commit_details", f"""
SELECT u.repo, u.discrepancy, 'origin/' || p.left_name AS left_branch, 'origin/' || p.right_name AS right_branch, u.sha AS "commit", c.authored_at AS created_at,
       c.author, c.author_email, c.message, f.path AS file_path,
       'Commits in ' || p.right_name || ' not present in ' || p.left_name || ' (cherry-pick, no merges).' AS problem_statement
FROM {{unique_commits}} u JOIN {{commits}} c ON c.repo = u.repo AND c.sha = u.sha JOIN {{commit_files}} f ON f.repo = u.repo AND f.sha = u.sha
JOIN {PAIRS} ON p.discrepancy = u.discrepancy""")
def _(v):
    return branches.commit_details(unique_commits(v), v.commits, v.commit_files)


# --- content drift ---------------------------------------------------------------------
def diff_sql(mode: str) -> str:
    left = (
        "SELECT repo, left_name AS a, right_name AS b, path, blob_hash FROM {base_files} UNION ALL SELECT repo, right_name AS a, left_name AS b, path, blob_hash FROM {base_files}"
    )
    if mode == DIRECT:
        old = f"SELECT p.discrepancy, f.repo, f.path, f.blob_hash FROM {{branch_files}} f JOIN {PAIRS} ON p.left_name = f.branch"
    else:
        old = f"SELECT p.discrepancy, f.repo, f.path, f.blob_hash FROM ({left}) f JOIN {PAIRS} ON p.left_name = f.a AND p.right_name = f.b"
    new = f"SELECT p.discrepancy, f.repo, f.path, f.blob_hash FROM {{branch_files}} f JOIN {PAIRS} ON p.right_name = f.branch"
    return f"""
SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.discrepancy, n.discrepancy) AS discrepancy, coalesce(o.path, n.path) AS path,
       CASE WHEN o.blob_hash IS NULL THEN 'A' WHEN n.blob_hash IS NULL THEN 'D' ELSE 'M' END AS code, o.blob_hash AS left_hash, n.blob_hash AS right_hash
FROM ({old}) o FULL JOIN ({new}) n ON o.repo = n.repo AND o.discrepancy = n.discrepancy AND o.path = n.path
WHERE o.blob_hash IS DISTINCT FROM n.blob_hash"""


V["diff_base"], V["diff_direct"] = diff_sql(MERGE_BASE), diff_sql(DIRECT)


def wide(v, mode=MERGE_BASE):
    return branches.wide_files(v.branch_files, None if mode == DIRECT else v.base_files)


@query("tree_diff_base", "SELECT * FROM {diff_base}")
def _(v):
    return branches.tree_diff(wide(v))


@query("tree_diff_direct", "SELECT * FROM {diff_direct}")
def _(v):
    return branches.tree_diff(wide(v, DIRECT), DIRECT)


def stored(v, mode: str = MERGE_BASE):
    path = scratch_path(v.spark, "trees")
    trees.store_trees(trees.branch_trees(v.branch_files, None if mode == DIRECT else v.base_files), path)
    return trees.stored_diff(trees.read_trees(v.spark, path), trees.tree_pairs(v.doc_repos, mode))


@query("stored_diff_base", "SELECT * FROM {diff_base}")
def _(v):
    return stored(v)


@query("stored_diff_direct", "SELECT * FROM {diff_direct}")
def _(v):
    return stored(v, DIRECT)


def renames_sql(diff: str) -> str:
    return f"""
SELECT * EXCLUDE (k, other), CASE WHEN code = 'A' AND k <= other THEN 'R100' ELSE code END AS raw_change_type FROM (
  SELECT d.*, CASE WHEN code = 'M' THEN 0 ELSE row_number() OVER (PARTITION BY repo, discrepancy, code, coalesce(right_hash, left_hash) ORDER BY path) END AS k,
         CASE WHEN code = 'M' THEN -1 ELSE (SELECT count(*) FROM {{{diff}}} x WHERE x.repo = d.repo AND x.discrepancy = d.discrepancy AND x.code IN ('A', 'D') AND x.code <> d.code
          AND coalesce(x.right_hash, x.left_hash) = coalesce(d.right_hash, d.left_hash)) END AS other
  FROM {{{diff}}} d)
WHERE NOT (code = 'D' AND k <= other)"""


V["renamed_direct"], V["renamed_base"] = renames_sql("diff_direct"), renames_sql("diff_base")


@query("renames", "SELECT * FROM {renamed_direct}")
def _(v):
    return branches.with_renames(branches.tree_diff(wide(v, DIRECT), DIRECT), mode=DIRECT)


@query("copies", f"""
SELECT r.* EXCLUDE (raw_change_type), CASE WHEN r.raw_change_type = 'A' AND EXISTS (SELECT 1 FROM {{branch_files}} f JOIN {PAIRS} ON p.left_name = f.branch
  WHERE f.repo = r.repo AND p.discrepancy = r.discrepancy AND f.blob_hash = r.right_hash) THEN 'C100' ELSE r.raw_change_type END AS raw_change_type
FROM {{renamed_direct}} r""")
def _(v):
    files = wide(v, DIRECT)
    return branches.with_renames(branches.tree_diff(files, DIRECT), files, DIRECT)


V["edited_diff"] = f"""
SELECT coalesce(l.repo, r.repo) AS repo, coalesce(l.discrepancy, r.discrepancy) AS discrepancy, coalesce(l.path, r.path) AS path,
       CASE WHEN l.path IS NULL THEN 'A' WHEN r.path IS NULL THEN 'D' ELSE 'M' END AS code, l.blob_hash AS left_hash, r.blob_hash AS right_hash
FROM (SELECT f.*, p.discrepancy FROM {{edited_hashes}} f JOIN {PAIRS} ON p.left_name = f.branch) l
FULL JOIN (SELECT f.*, p.discrepancy FROM {{edited_hashes}} f JOIN {PAIRS} ON p.right_name = f.branch) r
  ON l.repo = r.repo AND l.discrepancy = r.discrepancy AND l.path = r.path
WHERE l.blob_hash IS DISTINCT FROM r.blob_hash"""
V["edited_renamed"] = renames_sql("edited_diff")
V["edited_lines"] = """
SELECT repo, blob, line, count(*) AS m, sum(count(*)) OVER (PARTITION BY repo, blob) AS n
FROM (SELECT repo, blob, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line FROM {edited_blobs}) GROUP BY repo, blob, line"""


def similar_sql(code: str, column: str, right: str) -> str:
    """Scores of 50 to 99 of all pairs of the contents of one code with the contents of added paths, over all their lines."""
    return f"""
SELECT l.repo, l.discrepancy, l.b AS lb, r.b AS rb, least(floor(100 * s.shared / s.n), 99)::INTEGER AS score, l.c AS lc, r.c AS rc
FROM (SELECT repo, discrepancy, {column} AS b, count(*) AS c FROM {{edited_renamed}} WHERE raw_change_type = '{code}' GROUP BY ALL) l
JOIN (SELECT repo, discrepancy, right_hash AS b, count(*) AS c FROM {right} WHERE raw_change_type = 'A' GROUP BY ALL) r
  ON l.repo = r.repo AND l.discrepancy = r.discrepancy AND l.b <> r.b
JOIN (SELECT x.repo, x.blob AS lb, y.blob AS rb, sum(least(x.m, y.m)) AS shared, max(greatest(x.n, y.n)) AS n
      FROM {{edited_lines}} x JOIN {{edited_lines}} y ON x.repo = y.repo AND x.line = y.line GROUP BY ALL) s
  ON s.repo = l.repo AND s.lb = l.b AND s.rb = r.b
WHERE 100 * s.shared >= 50 * s.n"""


V["edited_scores"] = similar_sql("D", "left_hash", "{edited_renamed}")
# Pairs one after the other, best first; each takes as many paths as both contents have left.
V["edited_taken"] = """
SELECT repo, discrepancy, lb, rb, score, k, size, coalesce(sum(size) OVER (PARTITION BY repo, discrepancy, lb ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lf,
       coalesce(sum(size) OVER (PARTITION BY repo, discrepancy, rb ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rf
FROM (
  WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY repo, discrepancy ORDER BY score DESC, lb, rb) AS k FROM {edited_scores}),
  g AS (SELECT repo, discrepancy, 0::BIGINT AS k, NULL::VARCHAR AS lb, NULL::VARCHAR AS rb, 0 AS score, 0::BIGINT AS size, MAP {}::MAP(VARCHAR, BIGINT) AS used
        FROM (SELECT DISTINCT repo, discrepancy FROM o)
        UNION ALL
        SELECT repo, discrepancy, k, lb, rb, score, size,
               map_concat(used, MAP {'l' || lb: coalesce(used['l' || lb], 0) + size, 'r' || rb: coalesce(used['r' || rb], 0) + size})
        FROM (SELECT g.repo, g.discrepancy, o.k, o.lb, o.rb, o.score, g.used, least(o.lc - coalesce(g.used['l' || o.lb], 0), o.rc - coalesce(g.used['r' || o.rb], 0)) AS size
              FROM g JOIN o ON o.repo = g.repo AND o.discrepancy = g.discrepancy AND o.k = g.k + 1))
  SELECT * FROM g WHERE size > 0)"""
V["edited_moves"] = """
SELECT a.repo, a.discrepancy, a.path, d.path AS old_path, t.score
FROM {edited_taken} t
JOIN (SELECT *, row_number() OVER (PARTITION BY repo, discrepancy, left_hash ORDER BY path) AS i FROM {edited_renamed} WHERE raw_change_type = 'D') d
  ON d.repo = t.repo AND d.discrepancy = t.discrepancy AND d.left_hash = t.lb AND d.i > lf AND d.i <= lf + size
JOIN (SELECT *, row_number() OVER (PARTITION BY repo, discrepancy, right_hash ORDER BY path) AS i FROM {edited_renamed} WHERE raw_change_type = 'A') a
  ON a.repo = t.repo AND a.discrepancy = t.discrepancy AND a.right_hash = t.rb AND a.i > rf AND a.i <= rf + size AND a.i - rf = d.i - lf"""
V["edited_similar"] = """
SELECT r.* EXCLUDE (raw_change_type), CASE WHEN m.score IS NULL THEN raw_change_type ELSE format('R{:03d}', m.score) END AS raw_change_type, m.old_path
FROM {edited_renamed} r LEFT JOIN {edited_moves} m ON m.repo = r.repo AND m.discrepancy = r.discrepancy AND m.path = r.path
WHERE NOT (raw_change_type = 'D' AND EXISTS (SELECT 1 FROM {edited_moves} x WHERE x.repo = r.repo AND x.discrepancy = r.discrepancy AND x.old_path = r.path))"""


def edited(v) -> DataFrame:
    return branches.with_renames(branches.tree_diff(branches.wide_files(v.edited_hashes), DIRECT), mode=DIRECT)


@query("similar_renames", "SELECT * FROM {edited_similar}")
def _(v):
    return similarity.with_similar(edited(v), v.edited_blobs)


V["edited_copy_scores"] = similar_sql("M", "left_hash", "{edited_similar}")


@query("similar_copies", """
SELECT s.* EXCLUDE (raw_change_type, old_path), CASE WHEN c.score IS NULL THEN s.raw_change_type ELSE format('C{:03d}', c.score) END AS raw_change_type,
       coalesce(s.old_path, c.source) AS old_path
FROM {edited_similar} s LEFT JOIN (
  SELECT c.repo, c.discrepancy, c.rb, arg_min(c.score, (-c.score, c.lb)) AS score, arg_min(m.path, (-c.score, c.lb)) AS source
  FROM {edited_copy_scores} c JOIN (SELECT repo, discrepancy, left_hash, min(path) AS path FROM {edited_renamed} WHERE raw_change_type = 'M' GROUP BY ALL) m
    ON m.repo = c.repo AND m.discrepancy = c.discrepancy AND m.left_hash = c.lb GROUP BY ALL) c
ON c.repo = s.repo AND c.discrepancy = s.discrepancy AND c.rb = s.right_hash AND s.raw_change_type = 'A'""")
def _(v):
    return similarity.with_similar(edited(v), v.edited_blobs, copies=True)


KIND = "CASE regexp_replace(raw_change_type, '[0-9]+$', '') " + " ".join(f"WHEN '{k}' THEN '{d}'" for k, d in DIFFERENCE_TYPES.items()) + " END"
V["diff_kinds"] = f"SELECT *, {KIND} AS difference_type FROM {{renamed_base}}"
COUNTS = ", ".join(f"count(*) FILTER (WHERE difference_type = '{d}') AS {d}" for d in DIFFERENCE_COLUMNS)


def base_diff(v):
    return branches.with_renames(branches.tree_diff(wide(v)))


@query("difference_type_pivot", f"SELECT repo, discrepancy, {COUNTS} FROM {{diff_kinds}} GROUP BY ALL")
def _(v):
    return branches.difference_type_pivot(base_diff(v))


V["doc_directed"] = f"""
SELECT *, EXISTS (SELECT 1 FROM {{bases}} b WHERE b.repo = d.repo AND ((b.left_name = d.l AND b.right_name = d.r) OR (b.left_name = d.r AND b.right_name = d.l))) AS based
FROM (SELECT r.repo, p.discrepancy, p.left_name AS l, p.right_name AS r,
        EXISTS (SELECT 1 FROM {{doc_tips}} t WHERE t.repo = r.repo AND t.branch = p.left_name) AND EXISTS (SELECT 1 FROM {{doc_tips}} t WHERE t.repo = r.repo AND t.branch = p.right_name) AS complete
      FROM {{doc_repos}} r, {PAIRS}) d"""
V["content_counts"] = f"SELECT repo, discrepancy, count(DISTINCT path) AS unique_files, count(*) AS total_file_rows, {COUNTS} FROM {{diff_kinds}} GROUP BY ALL"
KNOWN = ", ".join(f"CASE WHEN d.complete AND d.based THEN coalesce(c.{n}, 0) END AS {n}" for n in ["unique_files", "total_file_rows", *DIFFERENCE_COLUMNS])
V["file_kpis"] = f"""
SELECT *, {graded('unique_files', 10, 50)} AS severity FROM (
  SELECT d.repo, d.discrepancy, 'origin/' || d.l AS left_branch, 'origin/' || d.r AS right_branch, 'content' AS drift_type, 'merge_base' AS comparison_mode,
         cast(NULL AS bigint) AS unique_commits, {KNOWN}, CASE WHEN NOT d.complete THEN 'missing_branch' WHEN NOT d.based THEN 'error' ELSE 'ok' END AS status
  FROM {{doc_directed}} d LEFT JOIN {{content_counts}} c ON c.repo = d.repo AND c.discrepancy = d.discrepancy)"""


def file_kpis(v):
    presence = branches.branch_presence(v.doc_repos, v.doc_tips)
    rows = branches.content_status(branches.repo_directions(presence), v.bases)
    return presence, branches.file_kpis(rows, branches.difference_counts(base_diff(v)))


@query("file_kpis", "SELECT * FROM {file_kpis}")
def _(v):
    return file_kpis(v)[1]


V["doc_presence"] = """
SELECT r.repo, coalesce(bool_or(t.branch = 'master'), false) AS has_master, coalesce(bool_or(t.branch = 'test'), false) AS has_test,
       coalesce(bool_or(t.branch = 'production'), false) AS has_production
FROM {doc_repos} r LEFT JOIN {doc_tips} t ON t.repo = r.repo GROUP BY r.repo"""


@query("file_matrix_content", matrix_sql("file_kpis", "doc_presence", "unique_files", "{right}_files_not_in_{left}_by_content"))
def _(v):
    presence, kpis = file_kpis(v)
    return branches.file_matrix_content(kpis, presence)


TEXTS = ", ".join(f"coalesce(cast({d} AS string), 'N/A') AS {d}_files" for d in DIFFERENCE_COLUMNS)


@query("totals_content", f"""
SELECT repo, discrepancy, left_branch, right_branch, comparison_mode AS compare_mode, coalesce(cast(total_file_rows AS string), 'N/A') AS total_file_rows,
       coalesce(cast(unique_files AS string), 'N/A') AS unique_files_affected, {TEXTS}, status FROM {{file_kpis}}""")
def _(v):
    return branches.totals_content(file_kpis(v)[1])


FACTS = [f"{p}_{f}" for p in ("created", "last_change") for f in ("commit", "at", "author", "author_email", "message")]
SHOWN = ", ".join(f"CASE WHEN m.path IS NULL THEN '' ELSE m.{f} END AS {f}" for f in FACTS)


@query("content_details", f"""
SELECT d.repo, d.discrepancy, 'origin/' || p.left_name AS left_branch, 'origin/' || p.right_name AS right_branch, 'merge_base' AS compare_mode, d.path AS file_path,
       d.raw_change_type, d.difference_type, m.path IS NOT NULL AS exists_on_right_branch, {SHOWN},
       'File differs between merge-base(origin/' || p.left_name || ', origin/' || p.right_name || ') and origin/' || p.right_name || ', matching GitLab compare semantics.' AS problem_statement
FROM {{diff_kinds}} d JOIN {PAIRS} ON p.discrepancy = d.discrepancy
LEFT JOIN {{doc_meta}} m ON m.repo = d.repo AND m.branch = p.right_name AND m.path = d.path""")
def _(v):
    return branches.content_details(base_diff(v), v.doc_meta, v.branch_files)


# --- executive summaries ---------------------------------------------------------------
INT = "coalesce(try_cast(%s AS bigint), 0)"
FILES, COMMITS = INT % "unique_files_affected", INT % "unique_commits"
V["totals_presence"] = "SELECT DISTINCT repo, true AS has_master, true AS has_test, true AS has_production FROM {totals}"
V["totals_matrix"] = matrix_sql("totals", "totals_presence", "nullif(unique_commits, 'N/A')", "{right}_not_in_{left}_commits_no_merges")


def totals_matrix(v):
    presence = v.totals.select("repo", *[F.lit(True).alias(f"has_{b}") for b in branches.BRANCHES]).distinct()
    kpis = v.totals.withColumn("unique_commits", F.nullif("unique_commits", F.lit("N/A")))
    return branches.commit_matrix(kpis, presence)


V["alignment"] = f"SELECT repo, count(*) FILTER (WHERE {FILES} > 0) AS nonzero_pairs, count(*) FILTER (WHERE {FILES} > 0) = 0 AS aligned FROM {{totals}} WHERE status = 'ok' GROUP BY repo"


@query("repo_alignment", "SELECT * FROM {alignment}")
def _(v):
    return executive.repo_alignment(v.totals)


SUM_FILES = ", ".join(
    f"(SELECT cast(coalesce(sum({FILES}), 0) AS bigint) FROM {{totals}} WHERE status = 'ok' AND discrepancy = '{d}') AS sum_unique_files_{d}" for d in executive.SUMMED_FILES
)
SUM_COMMITS = ", ".join(
    f"(SELECT cast(coalesce(sum({INT % (d + '_commits_no_merges')}), 0) AS bigint) FROM {{totals_matrix}}) AS sum_commits_{d}" for d in MATRIX_ORDER
)


@query("exec_summary", f"""
SELECT '2024-01-31' AS date_tag, (SELECT count(DISTINCT repo) FROM {{totals}}) AS total_repos, (SELECT count(*) FROM {{totals}}) AS total_repo_discrepancy_pairs,
       (SELECT count(*) FROM {{totals}} WHERE status = 'ok') AS pairs_ok, (SELECT count(*) FROM {{totals}} WHERE status <> 'ok') AS pairs_with_missing_branch,
       (SELECT count(*) FROM {{totals}} WHERE status = 'ok' AND {FILES} > 0) AS pairs_with_nonzero_files,
       (SELECT count(*) FROM {{alignment}}) AS repos_with_complete_branches, (SELECT count(*) FROM {{alignment}} WHERE aligned) AS repos_fully_aligned,
       (SELECT count(*) FROM {{alignment}} WHERE NOT aligned) AS repos_with_any_discrepancy, (SELECT count(*) FROM {{details}}) AS total_detail_rows,
       (SELECT count(DISTINCT file_path) FROM {{details}}) AS total_unique_files_across_detail, (SELECT count(DISTINCT "commit") FROM {{details}}) AS total_unique_commits_across_detail,
       (SELECT strftime(min(created_at), '%Y-%m-%d %H:%M:%S') || ' +00:00' FROM {{details}}) AS min_discrepancy_commit_date,
       (SELECT strftime(max(created_at), '%Y-%m-%d %H:%M:%S') || ' +00:00' FROM {{details}}) AS max_discrepancy_commit_date, {SUM_FILES}, {SUM_COMMITS}""")
def _(v):
    return executive.exec_summary(v.totals, v.details, totals_matrix(v), "2024-01-31")


@query("exec_top_repos", f"""
SELECT repo, cast(sum({FILES}) AS bigint) AS total_unique_files, count(*) FILTER (WHERE {FILES} > 0) AS nonzero_pairs FROM {{totals}} WHERE status = 'ok' GROUP BY repo""")
def _(v):
    return executive.top_repos(v.totals)


@query("exec_by_discrepancy", f"""
SELECT discrepancy, count(DISTINCT repo) FILTER (WHERE {FILES} > 0) AS repos_with_nonzero, cast(sum({FILES}) AS bigint) AS sum_unique_files,
       cast(sum({COMMITS}) AS bigint) AS sum_unique_commits FROM {{totals}} WHERE status = 'ok' GROUP BY discrepancy""")
def _(v):
    return executive.by_discrepancy(v.totals)


def contributors_sql(author: str) -> str:
    return f'SELECT {author} AS author, count(*) AS rows, count(DISTINCT "commit") AS unique_commits, count(DISTINCT file_path) AS unique_files FROM {{details}} GROUP BY ALL'


@query("contributors", contributors_sql("author"))
def _(v):
    return executive.contributors(v.details)


@query("contributors_normalized", contributors_sql(r"regexp_replace(author, '(?i) \(External\)$', '')"))
def _(v):
    return executive.contributors_normalized(v.details)


@query("message_signals", """
SELECT s.signal, count(d.message) AS row_count FROM (VALUES ('cherry-pick'), ('Merge branch'), ('revert'), ('patch:'), ('minor:'), ('major:')) AS s(signal)
LEFT JOIN {details} d ON contains(lower(d.message), lower(s.signal)) GROUP BY s.signal""")
def _(v):
    return executive.message_signals(v.details)


V["domain_month_type"] = """
SELECT split_part(file_path, '/', 1) AS domain, strftime(created_at, '%Y-%m') AS month_year, discrepancy, count(*) AS detail_rows,
       count(DISTINCT "commit") AS unique_commits, count(DISTINCT file_path) AS unique_files FROM {details} GROUP BY ALL"""


@query("domain_month_type", "SELECT * FROM {domain_month_type}")
def _(v):
    return executive.domain_month_type(v.details)


@query("domain_month", """
SELECT domain, month_year, cast(sum(detail_rows) AS bigint) AS detail_rows, cast(sum(unique_commits) AS bigint) AS unique_commits,
       cast(sum(unique_files) AS bigint) AS unique_files FROM {domain_month_type} GROUP BY ALL""")
def _(v):
    return executive.domain_month(executive.domain_month_type(v.details))
