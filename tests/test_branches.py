
import pytest

from plumbline.constants import DIRECT, DIRECTIONS
from plumbline.operators import branches
from tests.conftest import rows

COMMITS = "repo string, sha string, patch_id string, is_merge boolean"
CLOSURE = "repo string, branch string, sha string"
FILES = "repo string, branch string, path string, blob_hash string"


def test_presence_and_directions(table):
    repos = table("repo string", ("a",), ("b",))
    tips = table(CLOSURE, ("a", "master", "1"), ("a", "production", "2"))
    presence = branches.branch_presence(repos, tips)
    assert rows(presence) == [("a", True, False, True), ("b", False, False, False)]
    directed = branches.repo_directions(presence).collect()
    assert len(directed) == 12
    ok = sorted(r.discrepancy for r in directed if r.status == "ok")
    assert ok == ["master_not_in_prod", "prod_not_in_master"]


def test_patch_unique(table):
    commits = table(
        COMMITS,
        ("r", "common", "p0", False), ("r", "m1", "p1", False), ("r", "t1", "p1", False), ("r", "t2", "p2", False),
        ("r", "t3", "p3", True), ("r", "t4", "p0", False), ("r", "t5", None, False),
    )
    closure = table(
        CLOSURE,
        *[("r", "master", s) for s in ("common", "m1")], *[("r", "test", s) for s in ("common", "t1", "t2", "t3", "t4", "t5")],
        *[("r", "production", s) for s in ("common",)],
    )
    found = rows(branches.patch_unique(commits, closure))
    # t1 repeats the patch of m1; t3 is a merge; t4 repeats a patch both sides have, which hides nothing.
    assert [r for r in found if r[1] == "test_not_in_master"] == [("r", "test_not_in_master", s) for s in ("t2", "t4", "t5")]
    assert [r for r in found if r[1] == "master_not_in_test"] == []
    assert [r for r in found if r[1] == "master_not_in_prod"] == [("r", "master_not_in_prod", "m1")]
    assert {r[2] for r in found if r[1] == "test_not_in_prod"} == {"t1", "t2", "t4", "t5"}


def test_commit_without_files_counts(table):
    unique = table("repo string, discrepancy string, sha string", ("r", "test_not_in_master", "a"), ("r", "test_not_in_master", "b"))
    files = table("repo string, sha string, path string", ("r", "a", "x"), ("r", "a", "y"))
    assert rows(branches.commit_counts(unique, files)) == [("r", "test_not_in_master", 2, 2, 2)]


def test_matrix_and_totals_show_missing(table):
    repos, tips = table("repo string", ("r",)), table(CLOSURE, ("r", "master", "1"), ("r", "test", "2"))
    presence = branches.branch_presence(repos, tips)
    counts = table(
        "repo string, discrepancy string, unique_commits bigint, unique_files bigint, total_file_lines bigint", ("r", "test_not_in_master", 7, 3, 9)
    )
    kpis = branches.commit_kpis(branches.repo_directions(presence), counts)
    row = branches.commit_matrix(kpis, presence).first()
    assert row.test_not_in_master_commits_no_merges == "7" and row.master_not_in_test_commits_no_merges == "0"
    assert row.prod_not_in_master_commits_no_merges == "N/A"
    found = {r.discrepancy: r for r in branches.totals_commit(kpis).collect()}
    assert (found["test_not_in_master"].total_file_lines, found["prod_not_in_test"].unique_commits) == ("9", "N/A")
    graded = {r.discrepancy: r.severity for r in kpis.collect()}
    assert (graded["test_not_in_master"], graded["master_not_in_test"], graded["prod_not_in_test"]) == ("medium", "none", "N/A")


@pytest.fixture
def tree(table):
    return table(
        FILES,
        ("r", "master", "same", "h0"), ("r", "test", "same", "h0"), ("r", "master", "gone", "h1"), ("r", "test", "moved", "h1"),
        ("r", "master", "edit", "h2"), ("r", "test", "edit", "h3"), ("r", "test", "copy", "h0"), ("r", "test", "new", "h9"),
    )


def test_diff_swaps_sides(tree):
    diff = branches.tree_diff(branches.wide_files(tree), DIRECT).collect()
    swap = {"A": "D", "D": "A", "M": "M"}
    forward = {(r.path, r.code) for r in diff if r.discrepancy == "test_not_in_master"}
    back = {(r.path, swap[r.code]) for r in diff if r.discrepancy == "master_not_in_test"}
    assert forward == back == {("gone", "D"), ("moved", "A"), ("edit", "M"), ("copy", "A"), ("new", "A")}


def test_identical_sides_give_nothing(table):
    files = table(FILES, *[("r", b, "p", "h") for b in ("master", "test", "production")])
    assert rows(branches.tree_diff(branches.wide_files(files), DIRECT)) == []


def test_renames_and_copies(tree):
    wide = branches.wide_files(tree)
    diff = branches.tree_diff(wide, DIRECT).where("discrepancy = 'test_not_in_master'")
    plain = {(r.path, r.raw_change_type) for r in branches.with_renames(diff, mode=DIRECT).collect()}
    assert plain == {("moved", "R100"), ("edit", "M"), ("copy", "A"), ("new", "A")}
    copied = {(r.path, r.raw_change_type) for r in branches.with_renames(diff, wide, DIRECT).collect()}
    assert copied == {("moved", "R100"), ("edit", "M"), ("copy", "C100"), ("new", "A")}


def test_hot_blob_pairs_every_possible_rename(table):
    gone = [("r", "master", f"old{i:03}", "empty") for i in range(70)]
    new = [("r", "test", f"new{i:03}", "empty") for i in range(100)]
    diff = branches.tree_diff(branches.wide_files(table(FILES, *gone, *new)), DIRECT).where("discrepancy = 'test_not_in_master'")
    found = {r.path: r.raw_change_type for r in branches.with_renames(diff, mode=DIRECT).collect()}
    assert len(found) == 100
    assert {p for p, c in found.items() if c == "R100"} == {f"new{i:03}" for i in range(70)}
    assert {c for p, c in found.items() if p >= "new070"} == {"A"}


def test_error_status_without_base(table):
    repos = table("repo string", ("r",), ("s",))
    tips = table(CLOSURE, *[(r, b, "x") for r in "rs" for b in ("master", "test")])
    directed = branches.repo_directions(branches.branch_presence(repos, tips))
    bases = table("repo string, left_name string, right_name string", ("r", "test", "master"))
    status = {(r.repo, r.discrepancy): r.status for r in branches.content_status(directed, bases).collect()}
    assert status[("r", "test_not_in_master")] == "ok" and status[("s", "test_not_in_master")] == "error"
    assert status[("s", "prod_not_in_test")] == "missing_branch"


def test_six_directions():
    assert len({name for name, _, _ in DIRECTIONS}) == 6
