"""Labels, cut points and lists that results must agree on."""

# The six directed branch pairs. A direction lists what is on
# ``right`` and missing or different on ``left``.
DIRECTIONS = [
    ("prod_not_in_master", "master", "production"),
    ("prod_not_in_test", "test", "production"),
    ("test_not_in_master", "master", "test"),
    ("test_not_in_prod", "production", "test"),
    ("master_not_in_test", "test", "master"),
    ("master_not_in_prod", "production", "master"),
]
BRANCHES = ["master", "test", "production"]
REMOTE = "origin/"

# Column prefix and middle part of the matrix reports, in report order.
MATRIX_ORDER = [
    "master_not_in_test",
    "test_not_in_master",
    "prod_not_in_test",
    "test_not_in_prod",
    "prod_not_in_master",
    "master_not_in_prod",
]

# Name-status letters and the difference they stand for.
DIFFERENCE_TYPES = {
    "A": "right_only",
    "D": "deleted_in_right",
    "M": "different_content",
    "R": "renamed_in_right",
    "C": "copied_in_right",
    "T": "different_content",
    "U": "different_content",
    "X": "different_content",
}
DIFFERENCE_COLUMNS = [
    "right_only",
    "deleted_in_right",
    "renamed_in_right",
    "copied_in_right",
    "different_content",
]

# Severities by rank, and upper bounds of "low" and "medium".
SEVERITY_RANKS = {"high": 1, "medium": 2, "low": 3, "none": 4}
COMMIT_CUTS = (5, 20)
FILE_CUTS = (10, 50)

# Catalog type labels and their common form.
TYPE_ALIASES = {
    "base_table": "table",
    "stored_procedure": "procedure",
    "scalar_function": "function",
    "table_function": "function",
}

# Fixed value: what a run says of a product without target datasets.
NO_DATASETS = "No datasets resolved. BigQuery comparison will be skipped."

# Suffixes compared as text.
TEXT_SUFFIXES = ["sql", "yml", "yaml", "py", "txt", "md", "json"]

# Phrases counted in commit messages.
MESSAGE_SIGNALS = ["cherry-pick", "Merge branch", "revert", "patch:", "minor:", "major:"]

# CI jobs whose variables override the top-level ones, weakest first.
DEPLOY_JOBS = ["deploy_to_prod_bq", "deploy_to_prod_dbt", "deploy_to_prod_python"]
DATASETS_KEY = "BQ_DATASET_NAMES"

# Comparison modes.
COMMIT_MODE = "cherry_pick_no_merges"
MERGE_BASE = "merge_base"
DIRECT = "direct"

NOT_AVAILABLE = "N/A"

# Sentences of report rows, in printf form.
COMMIT_PROBLEM = "Commits in %s not present in %s (cherry-pick, no merges)."
BASE_PROBLEM = "File differs between merge-base(%s, %s) and %s, matching GitLab compare semantics."
TIPS_PROBLEM = "File differs between branch tips %s and %s."
FILE_ONLY_SOURCE = "File exists in rendered source snapshot but not in deployed GCS bucket."
FILE_ONLY_DEPLOYED = "File exists in deployed GCS bucket but not in rendered source snapshot."
FILE_DIFFERS = "File exists in both places but content hash differs."
OBJECT_ONLY_CATALOG = "Selected GCP environment contains %s with no matching DDL or dbt model in the selected source snapshot."
OBJECT_ONLY_SOURCE = "Object exists in the selected source snapshot but not in the selected GCP dataset inventory. source_kind=%s"
TYPE_DIFFERS = "Source type=%s, selected GCP object type=%s."
SCHEMA_DIFFERS = "missing_in_prod=%s; extra_in_prod=%s; type_mismatch=%s"
DEFINITION_DIFFERS = "Source view definition and selected GCP view definition differ after normalization."
