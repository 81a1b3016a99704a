"""Drift between branches: patch-unique commits and content differences.

All six directions are computed together: flags or hashes of the three branches
are brought into one row per commit or path, and the directions are unfolded
from that row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.constants import (
    BRANCHES,
    COMMIT_MODE,
    DIFFERENCE_COLUMNS,
    DIRECTIONS,
    MATRIX_ORDER,
    MERGE_BASE,
)
from plumbline.functions.labels import (
    commit_problem,
    commit_severity,
    content_problem,
    difference_type,
    directions,
    file_severity,
    na_string,
    ref,
)
from plumbline.operators.history import branch_flags, on
from plumbline.operators.skew import rank_within
from plumbline.session import cut_lineage

DIRECTION_KEY = ["repo", "discrepancy"]


def branch_presence(repos: DataFrame, tips: DataFrame) -> DataFrame:
    """``repo, has_master, has_test, has_production`` for every repository."""
    present = tips.groupBy("repo").agg(*[F.max(F.col("branch") == b).alias(f"has_{b}") for b in BRANCHES])
    flags = [F.coalesce(f"has_{b}", F.lit(False)).alias(f"has_{b}") for b in BRANCHES]
    return repos.select("repo").distinct().join(present, "repo", "left").select("repo", *flags)


def repo_directions(presence: DataFrame) -> DataFrame:
    """Six rows per repository, with ``missing_branch`` where either side is absent."""
    rows = presence.select("*", F.explode(directions()).alias("d")).select("*", "d.*").drop("d")

    def has(side: str) -> Column:
        chain = F.lit(False)
        for b in BRANCHES:
            chain = F.when(F.col(side) == b, F.col(f"has_{b}")).otherwise(chain)
        return chain

    complete = has("left_name") & has("right_name")
    return rows.select(
        "repo",
        "discrepancy",
        ref(F.col("left_name")).alias("left_branch"),
        ref(F.col("right_name")).alias("right_branch"),
        F.when(complete, F.lit("ok")).otherwise(F.lit("missing_branch")).alias("status"),
    )


def history_status(directed: DataFrame, closure: DataFrame, commits: DataFrame) -> DataFrame:
    """Set ``error`` on complete pairs with a side whose history cannot be read.

    A history cannot be read when one of its reachable commits has no record, as in a cut-off clone. Its counts
    would be too small, and a repository without any record would look as if it had no drift.
    """
    unread = closure.join(commits.select("repo", "sha"), ["repo", "sha"], "left_anti")
    sides = unread.groupBy("repo").agg(F.collect_set(ref(F.col("branch"))).alias("_unread"))  # at most one per branch
    broken = F.array_contains("_unread", F.col("left_branch")) | F.array_contains("_unread", F.col("right_branch"))
    status = F.when((F.col("status") == "ok") & F.coalesce(broken, F.lit(False)), F.lit("error")).otherwise(F.col("status"))
    return directed.join(sides, "repo", "left").withColumn("status", status).drop("_unread")


def _bits(test) -> Column:
    """Integer with one bit per direction for which ``test(left, right)`` holds."""
    total = F.lit(0)
    for i, (_, left, right) in enumerate(DIRECTIONS):
        total = total + F.when(test(left, right), F.lit(1 << i)).otherwise(F.lit(0))
    return total


def patch_unique(commits: DataFrame, closure: DataFrame) -> DataFrame:
    """Non-merge commits of the right branch whose patch the left branch lacks, per direction.

    A commit counts when only the right side reaches it and no commit that only
    the left side reaches has the same patch. Both tests are bits of one
    integer per commit; a patch carries the OR of its commits' bits, which
    combines on the map side. So one aggregation and one join by
    (repo, patch_id) serve all six directions, and a patch shared by very many
    commits is split by the skew join.
    """
    plain = commits.where(~F.col("is_merge")).select("repo", "sha", "patch_id")
    own = branch_flags(closure).join(plain, ["repo", "sha"]).select(
        "repo",
        "sha",
        "patch_id",
        _bits(lambda left, right: on(right) & ~on(left)).alias("right_only"),
        _bits(lambda left, right: on(left) & ~on(right)).alias("left_only"),
    ).where((F.col("right_only") > 0) | (F.col("left_only") > 0))
    taken = own.where(F.col("patch_id").isNotNull()).groupBy("repo", "patch_id").agg(F.bit_or("left_only").alias("taken"))
    kept = own.where(F.col("right_only") > 0).join(taken, ["repo", "patch_id"], "left")
    open_bits = F.col("right_only").bitwiseAND(F.bitwise_not(F.coalesce("taken", F.lit(0))))
    hits = F.filter(
        F.array(*[F.when(open_bits.bitwiseAND(F.lit(1 << i)) > 0, F.lit(name)) for i, (name, _, _) in enumerate(DIRECTIONS)]),
        lambda d: d.isNotNull(),
    )
    return kept.select("repo", F.explode(hits).alias("discrepancy"), "sha")


def commit_counts(unique: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Commits, file lines and distinct files per repository and direction.

    A commit is once in ``unique`` per direction, so commits need no distinct
    count. Commits without files count as commits and add no file.
    """
    commits = unique.groupBy(*DIRECTION_KEY).agg(F.count(F.lit(1)).alias("unique_commits"))
    by_path = (
        unique.join(commit_files.select("repo", "sha", "path"), ["repo", "sha"])
        .groupBy(*DIRECTION_KEY, "path")
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    files = by_path.groupBy(*DIRECTION_KEY).agg(
        F.count(F.lit(1)).alias("unique_files"), F.sum("lines").alias("total_file_lines")
    )
    return commits.join(files, DIRECTION_KEY, "left")


def commit_kpis(directed: DataFrame, counts: DataFrame) -> DataFrame:
    """KPI row per repository and direction; zero where nothing differs, NULL where a branch is missing or unreadable."""

    def known(name: str) -> Column:
        return F.when(F.col("status") == "ok", F.coalesce(name, F.lit(0))).alias(name)

    rows = directed.join(counts, DIRECTION_KEY, "left").select(
        "repo",
        "discrepancy",
        "left_branch",
        "right_branch",
        F.lit("commit").alias("drift_type"),
        F.lit(COMMIT_MODE).alias("comparison_mode"),
        known("unique_commits"),
        known("unique_files"),
        known("total_file_lines"),
        "status",
    )
    return rows.withColumn("severity", commit_severity(F.col("unique_commits")))


def commit_details(unique: DataFrame, commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """One row per direction, commit and file; commits without files give none."""
    names = F.map_from_entries(
        F.transform(directions(), lambda d: F.struct(d["discrepancy"], F.struct(d["left_name"], d["right_name"])))
    )
    facts = ["authored_at", "author", "author_email", "message"]
    rows = unique.join(commits.select("repo", "sha", *facts), ["repo", "sha"]).join(
        commit_files.select("repo", "sha", "path"), ["repo", "sha"]
    )
    named = rows.withColumn("_pair", F.try_element_at(names, F.col("discrepancy")))
    left, right = ref(F.col("_pair.left_name")), ref(F.col("_pair.right_name"))
    return named.select(
        "repo",
        "discrepancy",
        left.alias("left_branch"),
        right.alias("right_branch"),
        F.col("sha").alias("commit"),
        F.col("authored_at").alias("created_at"),
        "author",
        "author_email",
        "message",
        F.col("path").alias("file_path"),
        commit_problem(left, right).alias("problem_statement"),
    )


def matrix(kpis: DataFrame, presence: DataFrame, measure: str, column: str) -> DataFrame:
    """One row per repository with a column per direction, ``N/A`` where unknown.

    ``column`` is a pattern such as ``{right}_not_in_{left}_commits_no_merges``.
    """
    ok = F.when(F.col("status") == "ok", F.col(measure))
    values = kpis.select("repo", "discrepancy", ok.alias("v")).groupBy("repo").pivot("discrepancy", MATRIX_ORDER).agg(F.max("v"))
    named = []
    for name in MATRIX_ORDER:
        right, left = name.split("_not_in_")
        named.append(na_string(F.col(name)).alias(column.format(right=right, left=left)))
    return presence.join(values, "repo", "left").select("repo", *[f"has_{b}" for b in BRANCHES], *named)


def commit_matrix(kpis: DataFrame, presence: DataFrame) -> DataFrame:
    return matrix(kpis, presence, "unique_commits", "{right}_not_in_{left}_commits_no_merges")


def file_matrix_commit(kpis: DataFrame, presence: DataFrame) -> DataFrame:
    return matrix(kpis, presence, "unique_files", "{right}_files_not_in_{left}_no_merges")


def file_matrix_content(kpis: DataFrame, presence: DataFrame) -> DataFrame:
    return matrix(kpis, presence, "unique_files", "{right}_files_not_in_{left}_by_content")


def totals_commit(kpis: DataFrame) -> DataFrame:
    return kpis.select(
        "repo",
        "discrepancy",
        "left_branch",
        "right_branch",
        na_string(F.col("total_file_lines")).alias("total_file_lines"),
        na_string(F.col("unique_files")).alias("unique_files_affected"),
        na_string(F.col("unique_commits")).alias("unique_commits"),
        "status",
    )


def wide_files(branch_files: DataFrame, base_files: DataFrame | None = None) -> DataFrame:
    """One row per repository and path with the hash on each branch and each merge base.

    Six diffs need each branch file several times; one grouping by path replaces
    their joins. The key is a path, so no repository is gathered in one task.
    Base columns are named ``base_<a>_<b>`` by the sorted branch pair.
    """
    rows = branch_files.select("repo", "path", F.col("branch").alias("slot"), "blob_hash")
    slots = list(BRANCHES)
    if base_files is not None:
        ordered = F.concat_ws("_", F.lit("base"), F.least("left_name", "right_name"), F.greatest("left_name", "right_name"))
        rows = rows.unionByName(base_files.select("repo", "path", ordered.alias("slot"), "blob_hash"))
        slots += sorted({base_slot(left, right) for _, left, right in DIRECTIONS})
    return rows.groupBy("repo", "path").agg(*[F.max(F.when(F.col("slot") == s, F.col("blob_hash"))).alias(s) for s in slots])


def base_slot(a: str, b: str) -> str:
    first, second = sorted([a, b])
    return f"base_{first}_{second}"


def tree_diff(wide: DataFrame, mode: str = MERGE_BASE) -> DataFrame:
    """Paths that differ per direction: ``repo, discrepancy, path, code, left_hash, right_hash``.

    ``merge_base`` compares the common base with the right tip, ``direct`` the
    two tips. Codes are A, D and M.
    """
    entries = []
    for name, left, right in DIRECTIONS:
        old = F.col(base_slot(left, right)) if mode == MERGE_BASE else F.col(left)
        new = F.col(right)
        entry = F.struct(
            F.lit(name).alias("discrepancy"),
            F.when(old.isNull(), F.lit("A")).when(new.isNull(), F.lit("D")).otherwise(F.lit("M")).alias("code"),
            old.alias("left_hash"),
            new.alias("right_hash"),
        )
        entries.append(F.when(~old.eqNullSafe(new), entry))
    changed = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return wide.select("repo", "path", F.explode(changed).alias("e")).select("repo", "e.discrepancy", "path", "e.code", "e.left_hash", "e.right_hash")


def with_renames(diff: DataFrame, wide: DataFrame | None = None, mode: str = MERGE_BASE) -> DataFrame:
    """Turn an added path whose blob was deleted elsewhere into an exact rename ``R100``.

    Each deleted path serves one added path, both taken in path order; used
    deletions disappear. With ``wide`` given, added paths whose blob the left
    side still holds become copies ``C100``. Counts per blob decide most groups
    at once; only groups with unequal numbers are ranked, and the ranking splits
    a blob that very many paths share.
    """
    diff = cut_lineage(diff, "diff")  # read four times below; names and hashes only
    blob = F.when(F.col("code") == "A", F.col("right_hash")).otherwise(F.col("left_hash"))
    moved = diff.where(F.col("code").isin("A", "D")).withColumn("blob", blob)
    group = ["repo", "discrepancy", "blob"]
    counts = moved.groupBy(*group).agg(
        F.count_if(F.col("code") == "A").alias("added"), F.count_if(F.col("code") == "D").alias("deleted")
    )
    both = counts.where((F.col("added") > 0) & (F.col("deleted") > 0)).withColumn("pairs", F.least("added", "deleted"))
    paired = moved.join(both, group)
    exact = paired.where(F.col("added") == F.col("deleted")).withColumn("used", F.lit(True))
    uneven = rank_within(paired.where(F.col("added") != F.col("deleted")), [*group, "code"], ["path"], "rank")
    uneven = uneven.withColumn("used", F.col("rank") <= F.col("pairs"))
    used = exact.select("repo", "discrepancy", "path", "used").unionByName(
        uneven.where("used").select("repo", "discrepancy", "path", "used")
    )
    rows = diff.join(used, ["repo", "discrepancy", "path"], "left")
    is_used = F.coalesce("used", F.lit(False))
    renamed = rows.where(~(is_used & (F.col("code") == "D"))).withColumn(
        "raw_change_type", F.when(is_used & (F.col("code") == "A"), F.lit("R100")).otherwise(F.col("code"))
    ).drop("used")
    if wide is None:
        return renamed
    held = []
    for name, left, right in DIRECTIONS:
        held.append(F.struct(F.lit(name).alias("discrepancy"), F.col(base_slot(left, right) if mode == MERGE_BASE else left).alias("right_hash")))
    kept = (
        wide.select("repo", F.explode(F.array(*held)).alias("h"))
        .select("repo", "h.*")
        .where(F.col("right_hash").isNotNull())
        .distinct()
        .withColumn("held", F.lit(True))
    )
    copied = renamed.join(kept, ["repo", "discrepancy", "right_hash"], "left")
    code = F.when((F.col("raw_change_type") == "A") & F.col("held"), F.lit("C100")).otherwise(F.col("raw_change_type"))
    return copied.withColumn("raw_change_type", code).drop("held").select(*renamed.columns)


def content_status(directed: DataFrame, bases: DataFrame | None) -> DataFrame:
    """Set ``error`` on complete pairs that have no common base (``bases``: repo, left_name, right_name)."""
    if bases is None:
        return directed
    keyed = bases.select(
        F.col("repo"),
        F.least(ref(F.col("left_name")), ref(F.col("right_name"))).alias("_a"),
        F.greatest(ref(F.col("left_name")), ref(F.col("right_name"))).alias("_b"),
        F.lit(True).alias("_based"),
    ).distinct()
    rows = directed.withColumn("_a", F.least("left_branch", "right_branch")).withColumn("_b", F.greatest("left_branch", "right_branch"))
    joined = rows.join(keyed, ["repo", "_a", "_b"], "left")
    status = F.when((F.col("status") == "ok") & F.col("_based").isNull(), F.lit("error")).otherwise(F.col("status"))
    return joined.withColumn("status", status).select(*directed.columns)


def difference_counts(diff: DataFrame) -> DataFrame:
    """Rows, distinct files and one column per kind of difference; unknown codes are dropped."""
    known = diff.withColumn("difference_type", difference_type(F.col("raw_change_type"))).where(
        F.col("difference_type").isNotNull()
    )
    by_path = known.groupBy(*DIRECTION_KEY, "path", "difference_type").agg(F.count(F.lit(1)).alias("n"))
    return by_path.groupBy(*DIRECTION_KEY).agg(
        F.sum("n").alias("total_file_rows"),
        F.countDistinct("path").alias("unique_files"),
        *[F.coalesce(F.sum(F.when(F.col("difference_type") == d, F.col("n"))), F.lit(0)).alias(d) for d in DIFFERENCE_COLUMNS],
    )


def difference_type_pivot(diff: DataFrame) -> DataFrame:
    """Counts by kind of difference per repository and direction, zero-filled."""
    kinds = diff.select(*DIRECTION_KEY, difference_type(F.col("raw_change_type")).alias("difference_type"))
    pivoted = kinds.groupBy(*DIRECTION_KEY).pivot("difference_type", DIFFERENCE_COLUMNS).count()
    return pivoted.na.fill(0)


def file_kpis(directed: DataFrame, counts: DataFrame, mode: str = MERGE_BASE) -> DataFrame:
    def known(name: str) -> Column:
        return F.when(F.col("status") == "ok", F.coalesce(name, F.lit(0))).alias(name)

    rows = directed.join(counts, DIRECTION_KEY, "left").select(
        "repo",
        "discrepancy",
        "left_branch",
        "right_branch",
        F.lit("content").alias("drift_type"),
        F.lit(mode).alias("comparison_mode"),
        F.lit(None).cast("bigint").alias("unique_commits"),
        known("unique_files"),
        known("total_file_rows"),
        *[known(d) for d in DIFFERENCE_COLUMNS],
        "status",
    )
    return rows.withColumn("severity", file_severity(F.col("unique_files")))


def totals_content(kpis: DataFrame) -> DataFrame:
    return kpis.select(
        "repo",
        "discrepancy",
        "left_branch",
        "right_branch",
        F.col("comparison_mode").alias("compare_mode"),
        na_string(F.col("total_file_rows")).alias("total_file_rows"),
        na_string(F.col("unique_files")).alias("unique_files_affected"),
        *[na_string(F.col(d)).alias(f"{d}_files") for d in DIFFERENCE_COLUMNS],
        "status",
    )


def content_details(diff: DataFrame, meta: DataFrame, branch_files: DataFrame, mode: str = MERGE_BASE) -> DataFrame:
    """Diff rows with the history of the file on the right branch; blank where it is absent there."""
    names = F.map_from_entries(
        F.transform(directions(), lambda d: F.struct(d["discrepancy"], F.struct(d["left_name"], d["right_name"])))
    )
    rows = diff.withColumn("difference_type", difference_type(F.col("raw_change_type"))).where(
        F.col("difference_type").isNotNull()
    )
    rows = rows.withColumn("_pair", F.try_element_at(names, F.col("discrepancy"))).withColumn("branch", F.col("_pair.right_name"))
    existing = branch_files.select("repo", "branch", "path", F.lit(True).alias("exists_on_right_branch"))
    key = ["repo", "branch", "path"]
    joined = rows.join(existing, key, "left").join(meta, key, "left")
    left, right = ref(F.col("_pair.left_name")), ref(F.col("_pair.right_name"))
    exists = F.coalesce("exists_on_right_branch", F.lit(False))

    def shown(name: str) -> Column:
        return F.coalesce(F.when(exists, F.col(name).cast("string")), F.lit("")).alias(name)

    facts = ["commit", "at", "author", "author_email", "message"]
    return joined.select(
        "repo",
        "discrepancy",
        left.alias("left_branch"),
        right.alias("right_branch"),
        F.lit(mode).alias("compare_mode"),
        F.col("path").alias("file_path"),
        "raw_change_type",
        "difference_type",
        exists.alias("exists_on_right_branch"),
        *[shown(f"created_{f}") for f in facts],
        *[shown(f"last_change_{f}") for f in facts],
        content_problem(mode, left, right).alias("problem_statement"),
    )


# Sort keys of the report files.
SORT_MATRIX: Sequence[str] = ["repo"]
SORT_TOTALS: Sequence[str] = ["repo", "left_branch", "right_branch"]
SORT_COMMIT_DETAILS: Sequence[str] = ["repo", "discrepancy", "created_at", "commit", "file_path"]
SORT_CONTENT_DETAILS: Sequence[str] = ["repo", "discrepancy", "file_path"]
